"""Object stores: a folder with Parquet tables of objects and a versioned branch map.

A folder named by ``OBJECTS.json`` holds (digest, hash_name, blob, blob_len,
refs), each file sorted by digest and with a Bloom filter on it, so that reading
a few objects skips most of them.  Writing an object that is there does nothing;
two writers at once may both write one, which readers and ``compact`` see as one.
``branches/<version>.json`` is the whole branch map; a swap creates the next
version and fails if another did.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.digest import HASHES, NATIVE, digest_of
from siltstone.operators.encode import NAMESPACE, decode_commit, decode_large, decode_tree, encode_commit, large_blob, tree_blob
from siltstone.sources.tables import Files, write_scratch

OBJECTS = "digest binary, hash_name string, blob binary, blob_len long, refs array<binary>"
#: Up to so many digests are looked for by themselves instead of by a join with all.
FEW = 64
STORES: dict[str, type[Store]] = {}


class StoreError(Exception):
    """A store is missing, is there already, or lacks what was asked for."""


class Store:
    """A store at a path of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str, hash_name: str = NATIVE) -> None:
        self.spark, self.path, self.hash_name = spark, path.rstrip("/"), hash_name
        if hash_name not in HASHES:
            raise StoreError(f"no such hash: {hash_name}")
        self.files = Files(spark, self.path)

    @classmethod
    def init(cls, spark: SparkSession, path: str, hash_name: str = NATIVE) -> Store:
        store = cls(spark, path, hash_name)
        if not store.files.create("STORE.json", json.dumps({"uuid": str(uuid.uuid4()), "hash": hash_name})):
            raise StoreError(f"a store is at {path} already")
        spark.createDataFrame([], OBJECTS).write.parquet(f"{store.path}/objects")
        store.files.write_json("OBJECTS.json", {"folder": "objects"})
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        store = cls(spark, path)
        about = store.files.read_json("STORE.json")
        if about is None:
            raise StoreError(f"no store is at {path}")
        store.hash_name = about["hash"]
        return store

    @property
    def uuid(self) -> str:
        return self.files.read_json("STORE.json")["uuid"]

    @property
    def folder(self) -> str:
        return f"{self.path}/{self.files.read_json('OBJECTS.json', {'folder': 'objects'})['folder']}"

    def objects(self) -> DataFrame:
        return self.spark.read.schema(OBJECTS).parquet(self.folder)

    @staticmethod
    def _written(objects: DataFrame):
        """A writer of objects in order of their digests, with a Bloom filter."""
        ordered = objects.sortWithinPartitions("digest")
        return ordered.write.mode("append").option("compression", "zstd").option("parquet.bloom.filter.enabled#digest", "true")

    def compact(self) -> None:
        """Write all objects anew, each once, in few files by ranges of digests; readers of the old folder are not disturbed."""
        folder = f"objects-{uuid.uuid4().hex}"
        old = self.objects().dropDuplicates(["digest"])
        self._written(old.repartitionByRange("digest")).parquet(f"{self.path}/{folder}")
        self.files.write_json("OBJECTS.json", {"folder": folder})

    def put(self, objects: DataFrame) -> dict[str, int]:
        """Add objects that are not there; repeated ones once. How many were offered and were fresh, and the fresh ones' bytes."""
        new = objects.select("digest", "hash_name", "blob", F.col("blob_len").cast("long").alias("blob_len"), "refs").dropDuplicates(["digest"])
        wrong = F.when(F.col("hash_name") == self.hash_name, F.col("hash_name")).otherwise(F.raise_error(F.concat(F.lit("the store has another hash than "), "hash_name")))
        new = offered = write_scratch(new.withColumn("hash_name", wrong), "offered")
        some = [bytes(r["digest"]) for r in new.select("digest").limit(FEW + 1).collect()]
        if len(some) <= FEW:
            there = self.objects().where(F.col("digest").isin(some)) if some else self.objects().where("false")
        else:
            there = self.objects()
        new = new.join(there.select("digest"), "digest", "left_anti")
        fresh = write_scratch(new, "put")
        self._written(fresh).parquet(self.folder)
        return {"offered": offered.count(), **fresh.agg(F.count("*").alias("fresh"), F.coalesce(F.sum("blob_len"), F.lit(0)).alias("bytes")).first().asDict()}

    def get(self, digests: DataFrame) -> DataFrame:
        """The objects of digests (digest), each once; missing ones are left out."""
        return self.objects().join(digests.select("digest").distinct(), "digest", "left_semi").dropDuplicates(["digest"])

    def load(self, digest: bytes) -> tuple[bytes, list[bytes]]:
        row = self.objects().where(F.col("digest") == F.lit(digest)).select("blob", "refs").first()
        if row is None:
            raise StoreError(f"no object {digest.hex()}")
        return bytes(row["blob"]), [bytes(x) for x in row["refs"]]

    def resolve(self, refs: DataFrame) -> DataFrame:
        """Those of refs (digest, ...) that the store has."""
        return refs.join(self.objects().select("digest").distinct(), "digest", "left_semi")

    def resolve_typed(self, refs: DataFrame, kind: str) -> DataFrame:
        """Those of typed references (child STRUCT, ...) of one kind that the store has; they keep size and depth."""
        own = refs.where(F.col("child.kind") == kind).withColumn("digest", F.col("child.digest"))
        return self.resolve(own).select(*refs.columns)

    def digests_of(self, refs: DataFrame) -> DataFrame:
        """refs (child STRUCT, ...) with the digest each stands for, which must have this store's hash size."""
        size = HASHES[self.hash_name].size
        digest = F.col("child.digest")
        return refs.withColumn("digest", F.when(F.octet_length(digest) == size, digest).otherwise(F.raise_error(F.lit("a digest of another hash")).cast("binary")))

    # --- single typed objects

    def send(self, kind: str, value, namespace: str = NAMESPACE) -> dict:
        """Write one object and give its reference; value: bytes (small), entries (large, tree) or fields (commit)."""
        if kind == "small":
            (blob, refs), size, depth = (bytes(value), []), len(value), 0
        elif kind == "large":
            (blob, refs), size, depth = large_blob(value), max((e["end"] for e in value), default=0), 1 + max((e["child"]["depth"] or 0 for e in value), default=0)
        elif kind == "tree":
            (blob, refs), size, depth = tree_blob(value), None, None
        elif kind == "commit":
            (blob, refs), size, depth = encode_commit(value, namespace), None, None
        else:
            raise StoreError(f"no such kind of object: {kind}")
        digest = digest_of(blob, refs, self.hash_name)
        self.put(self.spark.createDataFrame([(digest, self.hash_name, blob, len(blob), refs)], OBJECTS))
        return {"kind": kind, "digest": digest, "size": size, "depth": depth}

    def fetch(self, ref: dict, namespace: str = NAMESPACE):
        """Read one object by its reference, decoded by its kind."""
        blob, refs = self.load(ref["digest"])
        if ref["kind"] == "small":
            return blob
        if ref["kind"] == "large":
            return decode_large(blob, refs, ref["size"], ref["depth"])
        if ref["kind"] == "tree":
            return decode_tree(blob, refs)
        if ref["kind"] == "commit":
            return decode_commit(blob, refs, namespace)
        raise StoreError(f"no such kind of object: {ref['kind']}")

    def search(self, prefix: bytes) -> DataFrame:
        """digest of objects that begin with some bytes."""
        return self.objects().where(F.startswith("digest", F.lit(prefix))).select("digest").distinct()

    def count(self) -> int:
        return self.catalog().count()

    def catalog(self) -> DataFrame:
        return self.objects().select("digest").distinct()

    def _version(self) -> int:
        return max((int(n.split(".")[0]) for n in self.files.names("branches") if n.endswith(".json")), default=0)

    def load_branches(self) -> dict[str, bytes]:
        v = self._version()
        return {k: bytes.fromhex(d) for k, d in self.files.read_json(f"branches/{v:012d}.json", {}).items()}

    def branches(self) -> DataFrame:
        rows = sorted(self.load_branches().items())
        return self.spark.createDataFrame(rows, "branch string, digest binary")

    def swap_branches(self, old: dict[str, bytes], new: dict[str, bytes]) -> None:
        """Replace the whole map if it still is ``old``."""
        v = self._version()
        if self.load_branches() != old:
            raise StoreError("the branches have changed")
        missing = set(new.values()) - set(old.values())
        if missing and self.resolve(self.spark.createDataFrame([(d,) for d in sorted(missing)], "digest binary")).count() != len(missing):
            raise StoreError("a branch would lead to an object that is not stored")
        if not self.files.create(f"branches/{v + 1:012d}.json", json.dumps({k: d.hex() for k, d in sorted(new.items())})):
            raise StoreError("the branches have changed")

    def swap_branch(self, name: str, old: bytes | None, new: bytes | None) -> None:
        """Compare and swap one branch; None stands for none."""
        now = self.load_branches()
        if now.get(name) != old:
            raise StoreError(f"the branch {name} has changed")
        after = {k: d for k, d in now.items() if k != name} | ({name: new} if new is not None else {})
        self.swap_branches(now, after)


class ReadThrough(Store):
    """A local store that fills what it lacks from a remote one when asked for it."""

    def __init__(self, spark: SparkSession, path: str, hash_name: str = NATIVE, remote: Store | None = None) -> None:
        super().__init__(spark, path, hash_name)
        self.remote = remote

    @classmethod
    def over(cls, local: Store, remote: Store) -> ReadThrough:
        if local.hash_name != remote.hash_name:
            raise StoreError("the stores have different hashes")
        return cls(local.spark, local.path, local.hash_name, remote)

    def fill(self, digests: DataFrame) -> dict[str, int]:
        """Copy what is asked for and not here."""
        missing = write_scratch(digests.select("digest").distinct().join(self.catalog(), "digest", "left_anti"), "missing")
        return self.put(self.remote.get(missing)) if not missing.isEmpty() else {"offered": 0, "fresh": 0, "bytes": 0}

    def get(self, digests: DataFrame) -> DataFrame:
        self.fill(digests)
        return super().get(digests)

    def load(self, digest: bytes) -> tuple[bytes, list[bytes]]:
        self.fill(self.spark.createDataFrame([(digest,)], "digest binary"))
        return super().load(digest)


for _scheme in ("", "file", "hdfs", "s3a", "abfss", "gs", "viewfs"):
    STORES[_scheme] = Store


def kind_of(url: str) -> str:
    """A URL's scheme, which must have a store class."""
    scheme = urlparse(url).scheme
    if scheme not in STORES:
        raise StoreError(f"no store for {url}")
    return scheme


def open_store(spark: SparkSession, url: str) -> Store:
    return STORES[kind_of(url)].open(spark, url)


def init_store(spark: SparkSession, url: str, hash_name: str = NATIVE) -> Store:
    return STORES[kind_of(url)].init(spark, url, hash_name)
