"""Branches, remotes and upstreams as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def all_branches(local: DataFrame, remote: DataFrame, kind: str | None = None) -> DataFrame:
    """kind, remote, branch, digest of local (branch, digest) and remote (remote, branch, digest) branches, or of one kind."""
    both = local.select(F.lit("local").alias("kind"), F.lit(None).cast("string").alias("remote"), "branch", "digest").unionByName(remote.select(F.lit("remote").alias("kind"), "remote", "branch", "digest"))
    return both if kind is None else both.where(F.col("kind") == kind)


def branch_list(local: DataFrame, upstreams: DataFrame, head: str | None) -> DataFrame:
    """branch, digest, upstream (remote/branch or null), is_head."""
    named = upstreams.select("branch", F.concat_ws("/", "remote", "remote_branch").alias("upstream"))
    return local.join(named, "branch", "left").select("branch", "digest", "upstream", (F.col("branch") == F.lit(head)).alias("is_head") if head else F.lit(False).alias("is_head"))


def resolved(refs: DataFrame, branches: DataFrame, head: bytes | None, required: bool = False) -> DataFrame:
    """refs (kind, remote, branch) with the digest they stand for; required ones must have one."""
    found = branches.select("kind", F.coalesce("remote", F.lit("")).alias("_remote"), "branch", "digest")
    out = refs.withColumn("_remote", F.coalesce("remote", F.lit(""))).join(found, ["kind", "_remote", "branch"], "left").drop("_remote")
    out = out.withColumn("digest", F.when(F.col("kind") == "head", F.lit(head)).otherwise(F.col("digest")))
    if required:
        out = out.withColumn("digest", F.coalesce("digest", F.raise_error(F.concat(F.lit("no such reference: "), F.coalesce("branch", F.lit("HEAD")))).cast("binary")))
    return out


def merged_right(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The union of two maps given as rows; the right one wins."""
    return left.join(right.select(key), key, "left_anti").unionByName(right)


def same_map(a: DataFrame, b: DataFrame) -> bool:
    """Whether two sets of rows are equal: the precondition of a compare-and-swap."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).union(b.exceptAll(a))
