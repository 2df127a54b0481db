"""File caches and working-tree indexes: joins of what was recorded with what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.state import cache_status, inode_unchanged, updated_hygiene
from siltstone.functions.text import selected
from siltstone.sources.tables import unsent


def status(cache: DataFrame, files: DataFrame) -> DataFrame:
    """path, status, unchanged (null: can't be told), child, inode for cache (path, child, inode) against files (path, inode)."""
    old, new = cache.select("path", "child", F.col("inode").alias("old")), files.select("path", F.col("inode").alias("new"))
    both = old.join(unsent(new), "path", "full_outer")  # a filter on the status may make it an inner one
    has_old, has_new = F.col("old").isNotNull(), F.col("new").isNotNull()
    return both.select("path", cache_status(has_old, has_new).alias("status"), F.when(has_old & has_new, inode_unchanged(F.col("old"), F.col("new"))).alias("unchanged"), "child", F.col("new").alias("inode"))


def to_hash(cache: DataFrame, files: DataFrame, stored: DataFrame) -> DataFrame:
    """path of files that must be read: all but the positively unchanged ones whose object is stored (digest)."""
    known = status(cache, files).where("status = 'extant' and unchanged and child is not null")
    known = known.withColumn("digest", F.col("child.digest")).join(stored.select("digest"), "digest", "left_semi")
    return files.join(unsent(known.select("path")), "path", "left_anti")


def resolve(cache: DataFrame, snapshots: DataFrame, files: DataFrame, required: bool = False) -> DataFrame:
    """The cache with snapshots (path, child, inode) written, each only if its file has positively not changed since.

    A file that has, or may have, changed is left out; if ``required``, it is an error.
    """
    now = snapshots.join(unsent(files.select("path", F.col("inode").alias("now"))), "path", "left" if required else "inner")
    same = F.coalesce(inode_unchanged(F.col("inode"), F.col("now")), F.lit(False))
    if required:
        same = F.when(same, same).otherwise(F.raise_error(F.concat(F.lit("changed meanwhile: "), F.col("path").cast("string"))).cast("boolean"))
    fresh = now.where(same).select("path", "child", F.col("now").alias("inode"))
    return cache.join(unsent(fresh.select("path")), "path", "left_anti").unionByName(fresh)


def update_index(index: DataFrame, files: DataFrame, now) -> DataFrame:
    """Index rows (path, metadata STRUCT with mtime, hygiene, ...) brought up to date; ``now`` is the index's time.

    Entries whose file is gone are dirty; files without an entry are left out.
    """
    fresh = files.select("path", F.col("metadata").alias("_fresh"))
    same = F.col("_fresh").isNotNull() & F.col("metadata").eqNullSafe(F.col("_fresh"))
    joined = index.join(fresh, "path", "left")
    return joined.withColumn("hygiene", updated_hygiene(F.col("hygiene"), same, F.lit(now), F.col("metadata.mtime"))).drop("_fresh")


def clean_index(index: DataFrame, hashed: DataFrame) -> DataFrame:
    """The index with hashed (path, digest, size) recorded; hashing an entry that is not clean is an error."""
    both = index.join(hashed.select("path", F.struct("digest", "size").alias("_cached")), "path", "left")
    ok = F.when(F.col("_cached").isNull() | (F.col("hygiene") == "clean"), F.coalesce("_cached", "cached")).otherwise(F.raise_error(F.concat(F.lit("changed meanwhile: "), "path")).cast(index.schema["cached"].dataType))
    return both.withColumn("cached", ok).drop("_cached")


def prune_index(index: DataFrame) -> DataFrame:
    """Without entries of which nothing is left: not tracked, not added, nothing cached."""
    return index.where("tracked or added or cached is not null")


def set_tracked(index: DataFrame, paths: DataFrame, tracked: bool) -> DataFrame:
    """Track or untrack paths."""
    hit = paths.select("path", F.lit(True).alias("_hit")).distinct()
    return index.join(hit, "path", "left").withColumn("tracked", F.when(F.col("_hit"), F.lit(tracked)).otherwise(F.col("tracked"))).drop("_hit")


def register(index: DataFrame, files: DataFrame, include: str) -> DataFrame:
    """The index with files (path, metadata) that match a glob and are not in it yet, as added."""
    new = files.where(selected(F.col("path"), F.lit(False), F.lit(False), include, None)).join(index.select("path"), "path", "left_anti")
    kinds = {f.name: f.dataType for f in index.schema}
    made = {"hygiene": F.lit("dirty"), "tracked": F.lit(False), "added": F.lit(True), "cached": F.lit(None).cast(kinds["cached"])}
    return index.unionByName(new.select(*[made[c].alias(c) if c in made else F.col(c) for c in index.columns]))


def select_entries(index: DataFrame, include: str | None, exclude: str | None) -> DataFrame:
    """(included or added or tracked) and not excluded."""
    return index.where(selected(F.col("path"), F.col("added"), F.col("tracked"), include, exclude))
