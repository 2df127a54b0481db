"""Directory trees: building them bottom up, flattening them, looking up paths.

A flat tree has rows (path ARRAY<STRING>, child STRUCT), directories included
but for the root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.digest import NATIVE, digest_of, object_digest
from siltstone.operators.encode import REF, decoded_trees, encode_tree
from siltstone.sources.tables import write_scratch

FLAT = f"path array<string>, child {REF}"


def parent_of(path: str = "path"):
    return F.slice(path, F.lit(1), F.size(path) - 1)


def build_tree(leaves: DataFrame, hash_name: str = NATIVE) -> tuple[DataFrame, DataFrame]:
    """The root (child) and the tree objects for rows (path, child); one step for each level of depth.

    A leaf may itself be a tree (an empty directory, or one stored before).
    """
    spark = leaves.sparkSession
    deepest = leaves.agg(F.max(F.size("path"))).first()[0] or 0
    built, objects = None, None
    for level in range(deepest, 0, -1):
        entries = leaves.where(F.size("path") == level)
        entries = entries if built is None else entries.unionByName(built)
        named = entries.select(parent_of().alias("parent"), F.element_at("path", -1).alias("name"), "child")
        encoded = write_scratch(encode_tree(named).withColumn("digest", object_digest(F.col("blob"), F.col("refs"), hash_name)), "level")  # the next level and the objects read it
        made = encoded.select("digest", F.lit(hash_name).alias("hash_name"), "blob", F.octet_length("blob").cast("long").alias("blob_len"), "refs")
        objects = made if objects is None else objects.unionByName(made)
        built = encoded.select(F.col("parent").alias("path"), F.struct(F.lit("tree").alias("kind"), "digest", F.lit(None).cast("long").alias("size"), F.lit(None).cast("smallint").alias("depth")).alias("child"))
    if built is None:
        digest = digest_of(b"", [], hash_name)
        root = spark.createDataFrame([(("tree", digest, None, None),)], f"child {REF}")
        return root, spark.createDataFrame([(digest, hash_name, b"", 0, [])], "digest binary, hash_name string, blob binary, blob_len long, refs array<binary>")
    return built.select("child"), objects


def entries_of(objects: DataFrame, directories: DataFrame, *keys: str) -> DataFrame:
    """path, keys and child of the entries of directories (path, digest, keys); objects may be there twice."""
    met = objects.select("digest", "blob", "refs").join(directories.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
    stored = directories.select("path", *keys, "digest").join(met, "digest")
    return decoded_trees(stored, ["path", *keys]).select(F.array_append("path", F.col("name")).alias("path"), *keys, "child")


def flatten(objects: DataFrame, root: bytes, wanted: DataFrame | None = None, max_depth: int = 256) -> DataFrame:
    """All paths of a stored tree, level by level; each level reads the directories of its frontier only.

    With wanted (path) only those paths and what is above them are met.
    """
    spark = objects.sparkSession
    frontier = spark.createDataFrame([([], root)], "path array<string>, digest binary")
    out = spark.createDataFrame([], FLAT)
    for depth in range(1, max_depth + 1):
        level = entries_of(objects, frontier)
        if wanted is not None:
            above = wanted.where(F.size("path") >= depth).select(F.slice("path", 1, depth).alias("path"))
            level = level.join(above, "path", "left_semi")
        level = write_scratch(level, "level")
        out = out.unionByName(level)
        frontier = level.where("child.kind = 'tree'").select("path", F.col("child.digest").alias("digest"))
        if frontier.isEmpty():
            return out
    raise ValueError(f"the tree is deeper than {max_depth}")


def with_directories(leaves: DataFrame) -> DataFrame:
    """path and kind of leaves and of every directory above them."""
    up = leaves.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", F.lit(1), n))).alias("path")).where(F.size("path") > 0).distinct() if leaves is not None else None
    return leaves.select("path", F.col("child.kind").alias("kind")).unionByName(up.select("path", F.lit("tree").alias("kind")))


def look_up(flat: DataFrame, wanted: DataFrame) -> DataFrame:
    """path, child for wanted paths; child is null where there is none."""
    return wanted.select("path").join(flat, "path", "left")


def listing(objects: DataFrame, root: bytes, path: list[str]) -> DataFrame:
    """name, kind, size, digest of a stored directory's own entries, none where no directory is.

    Only the directories on the way are read, one at a time.
    """
    spark = objects.sparkSession

    def entries(digest: bytes) -> DataFrame:
        found = objects.where(F.col("digest") == F.lit(digest)).dropDuplicates(["digest"])
        return decoded_trees(found, ["digest"]).select("name", "child")

    here = entries(root)
    for name in path:
        step = here.where((F.col("name") == name) & (F.col("child.kind") == "tree")).select("child.digest").first()
        if step is None:
            return spark.createDataFrame([], "name string, kind string, size long, digest binary")
        here = entries(bytes(step["digest"]))
    return here.select("name", "child.kind", "child.size", "child.digest")
