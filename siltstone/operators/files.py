"""Files as objects: a small one, or a large one that lists its chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.digest import NATIVE, object_digest
from siltstone.operators.chunk import Parameters, chunk_blobs, group_rows
from siltstone.operators.encode import encode_large
from siltstone.sources.tables import unsent, write_scratch


def with_offsets(items: DataFrame, parent: str, order: str, size: str = "size") -> DataFrame:
    """Adds start and end: running offsets of ordered items within their parent."""
    before = Window.partitionBy(parent).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(size).over(before), F.lit(0))
    return items.withColumn("start", start).withColumn("end", F.col("start") + F.col(size))


def long_offsets(items: DataFrame, parent: str, order: str, size: str = "size") -> DataFrame:
    """Adds place, start and end: ``with_offsets`` for parents of any number of items; place counts them from 0.

    No two items of a parent should share their place in ``order``; a null size
    is 0.  Items are dealt by ranges, so a parent may be in many tasks.  Each
    counts from the beginnings of its pieces; only the pieces' totals meet.
    """
    sized = F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long"))
    named = items.select(F.struct(parent).alias("_parent"), F.col(order).alias("_order"), F.struct(*items.columns).alias("_row"), sized.alias("_size"))
    dealt = named.repartitionByRange("_parent", "_order").sortWithinPartitions("_parent", "_order").drop("_order")
    schema = dealt.select(F.lit(0).alias("_part"), "_parent", "_row", "_size", F.col("_size").alias("_start"), F.col("_size").alias("_at")).schema

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, offset, at = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            names, sizes = batch["_parent"].to_pylist(), batch["_size"].to_numpy(zero_copy_only=False)
            starts, places = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
            a = 0
            for b in range(1, len(names) + 1):
                if b == len(names) or names[b] != names[a]:
                    if names[a] != now:
                        now, offset, at = names[a], 0, 0
                    ends = offset + np.cumsum(sizes[a:b])
                    starts[a:b], places[a:b] = ends - sizes[a:b], np.arange(at, at + b - a)
                    offset, at, a = int(ends[-1]), at + b - a, b
            own = [pa.array(np.full(len(names), part, np.int32)), batch["_parent"], batch["_row"], batch["_size"], pa.array(starts), pa.array(places)]
            yield pa.RecordBatch.from_arrays(own, schema.names)

    rows = write_scratch(dealt.mapInArrow(counted, schema), "places")  # where the bounds fall is settled once
    before = Window.partitionBy("_parent").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_parent", "_part").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
    totals = write_scratch(totals.select("_parent", "_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_bytes", "_rows"))), "totals")
    start = F.col("_start") + F.col("_bytes")
    return rows.join(totals, ["_parent", "_part"]).select("_row.*", (F.col("_at") + F.col("_rows")).alias("place"), start.alias("start"), (start + F.col("_size")).alias("end"))


def share(files: DataFrame, key: str, data: str, p: Parameters = Parameters(), hash_name: str = NATIVE) -> tuple[DataFrame, DataFrame]:
    """Chunk files into objects.

    Returns the references (key, child STRUCT: small for up to one chunk, else
    large of depth 1) and the objects (digest, hash_name, blob, blob_len, refs),
    repeated objects included.  Chunks are written once, since both are made of them.
    """
    pieces = write_scratch(chunk_blobs(files, [key], data, p).withColumn("digest", object_digest(F.col("blob"), None, hash_name)), "pieces")
    none = F.array().cast("array<binary>")
    smalls = pieces.select("digest", F.lit(hash_name).alias("hash_name"), "blob", F.octet_length("blob").cast("long").alias("blob_len"), none.alias("refs"))
    child = F.struct(F.lit("small").alias("kind"), "digest", (F.col("end") - F.col("start")).alias("size"), F.lit(0).cast("smallint").alias("depth"))
    listed = pieces.select(key, "ordinal", "start", "end", child.alias("child"))
    counted = listed.groupBy(key).agg(F.count("*").alias("n"), F.max("end").alias("size"), F.first("child").alias("only"))
    several = listed.join(unsent(counted.where("n > 1").select(key)), key, "left_semi")
    encoded = encode_large(several, key).withColumn("digest", object_digest(F.col("blob"), F.col("refs"), hash_name))
    larges = encoded.select("digest", F.lit(hash_name).alias("hash_name"), "blob", F.octet_length("blob").cast("long").alias("blob_len"), "refs")
    big = F.struct(F.lit("large").alias("kind"), "digest", "size", F.lit(1).cast("smallint").alias("depth"))
    refs = counted.where("n = 1").select(key, F.col("only").alias("child")).unionByName(encoded.join(unsent(counted.select(key, "size")), key).select(key, big.alias("child")))
    return refs, smalls.unionByName(larges)


def overlapping(entries: DataFrame, lo: int, hi: int) -> DataFrame:
    """Entries that share a byte with lo..hi, one that begins before it included."""
    return entries.where((F.col("start") < hi) & (F.col("end") > lo))


def range_delta(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Entries (keys, start, end, digest) of new that old has not at the same place: what a checkout rewrites."""
    return new.join(unsent(old), [*keys, "start", "end", "digest"], "left_anti")


def reassembled(entries: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """key, data: files put together from their chunks (a file is one value, up to 2 GB)."""
    blobs = entries.join(objects.select(F.col("digest").alias("_digest"), "blob"), F.col("child.digest") == F.col("_digest")).select(key, "start", "blob")
    return blobs.groupBy(key).agg(F.coalesce(F.expr("listagg(blob) WITHIN GROUP (ORDER BY start)"), F.lit(b"")).alias("data"))


def hierarchy(entries: DataFrame, key: str, limit: int = 1024, hash_name: str = NATIVE, order: str = "start", **rule: int) -> tuple[DataFrame, DataFrame]:
    """Large objects of large objects for rows (key, start, end, child, signature), until a file has at most ``limit`` entries.

    Returns the file's reference (key, child) and the objects made.  At each
    level the entries of files that have more than ``limit`` are grouped by
    ``chunk.group_rows``; a group becomes a large object whose entries count from
    its own start, and its signature is the sum of its entries', modulo 256.
    Entries that may be empty need an ``order`` that no two of a file share.
    Each level's objects are written once, for the next level and for the result.
    """
    depth, objects, done = 1, None, None
    own_order = "start" if order == "start" else "_place"
    now = write_scratch(entries.select(F.struct(key).alias("_file"), F.col(order).alias("_place"), "start", "end", "child", "signature"), "level")
    while True:
        counted = write_scratch(now.groupBy("_file").agg(F.count("*").alias("n"), F.max("end").alias("size")), "counted")
        many = write_scratch(counted.where(F.col("n") > limit).select("_file"), "many")
        top = encode_large(now.join(many, "_file", "left_anti"), "_file", own_order).withColumn("digest", object_digest(F.col("blob"), F.col("refs"), hash_name))
        top = write_scratch(top.join(unsent(counted.select("_file", "size")), "_file"), "larges")
        made = _stored(top, hash_name)
        found = top.select(F.col("_file")[key].alias(key), F.struct(F.lit("large").alias("kind"), "digest", "size", F.lit(depth).cast("smallint").alias("depth")).alias("child"))
        done, objects = (found, made) if done is None else (done.unionByName(found), objects.unionByName(made))
        if many.isEmpty():
            return done, objects
        grouped = write_scratch(group_rows(now.join(many, "_file", "left_semi"), ["_file"], "_place", "signature", **rule), "groups").withColumn("_group", F.struct("_file", "group"))
        own = grouped.withColumn("_first", F.min("start").over(Window.partitionBy("_group")))
        lifted = own.select("_group", "_place", (F.col("start") - F.col("_first")).alias("start"), (F.col("end") - F.col("_first")).alias("end"), "child")
        encoded = encode_large(lifted, "_group", own_order).withColumn("digest", object_digest(F.col("blob"), F.col("refs"), hash_name))
        spans = grouped.groupBy("_group").agg(F.min("_place").alias("_place"), F.min("start").alias("start"), F.max("end").alias("end"), F.pmod(F.sum("signature"), F.lit(256)).cast("int").alias("signature"))
        larges = write_scratch(encoded.join(unsent(spans), "_group"), "larges")
        objects = objects.unionByName(_stored(larges, hash_name))
        up = F.struct(F.lit("large").alias("kind"), "digest", (F.col("end") - F.col("start")).alias("size"), F.lit(depth).cast("smallint").alias("depth"))
        now = larges.select(F.col("_group._file").alias("_file"), "_place", "start", "end", up.alias("child"), "signature")
        depth += 1


def _stored(encoded: DataFrame, hash_name: str) -> DataFrame:
    return encoded.select("digest", F.lit(hash_name).alias("hash_name"), "blob", F.octet_length("blob").cast("long").alias("blob_len"), "refs")


def summary(objects: DataFrame) -> DataFrame:
    """children, objects, blob_bytes: how many objects have how many references, and their content."""
    return objects.groupBy(F.size("refs").alias("children")).agg(F.count("*").alias("objects"), F.sum(F.octet_length("blob")).alias("blob_bytes"))
