"""Three-valued certainty, whether a file has changed, and the hygiene of index entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def certain(condition: Column) -> Column:
    """Positive or negative; unknown if null."""
    return condition.cast("boolean")


def positive_or_unknown(condition: Column) -> Column:
    return F.when(condition, F.lit(True))


def certainty_and(a: Column, b: Column) -> Column:
    return a & b


def certainty_or(a: Column, b: Column) -> Column:
    """By Kleene: positive if either is."""
    return a | b


def certainty_not(a: Column) -> Column:
    return ~a


def ns_from(seconds: Column, nanos: Column) -> Column:
    """Nanoseconds of a time; null beyond 64 bits."""
    return F.try_add(F.try_multiply(seconds.cast("long"), F.lit(1_000_000_000)), nanos.cast("long"))


def inode_unchanged(old: Column, new: Column) -> Column:
    """Whether two inode snapshots show the same content: true, false, or null if it can't be told.

    A version decides where both have one.  Times decide only if both were
    older than the moment of their snapshot; else a later change in the same
    instant could hide.
    """
    same_file = (old["number"] == new["number"]) & (old["generation"] == new["generation"])
    both_versions = old["version"].isNotNull() & new["version"].isNotNull()
    both_times = old["version"].isNull() & new["version"].isNull() & old["ctime_ns"].isNotNull() & new["ctime_ns"].isNotNull()
    settled = [positive_or_unknown((x["ctime_ns"] < x["timestamp_ns"]) & (x["mtime_ns"] < x["timestamp_ns"])) for x in (old, new)]
    same_times = (old["ctime_ns"] == new["ctime_ns"]) & (old["mtime_ns"] == new["mtime_ns"])
    unmodified = F.when(both_versions, old["version"] == new["version"]).when(both_times, settled[0] & settled[1] & same_times)
    return same_file & unmodified


def cache_status(has_entry: Column, has_file: Column) -> Column:
    """extant, removed, new or extinct."""
    return F.when(has_entry & has_file, "extant").when(has_entry, "removed").when(has_file, "new").otherwise("extinct")


def updated_hygiene(hygiene: Column, same_metadata: Column, index_time: Column, modified: Column) -> Column:
    """A dirty entry stays dirty; an equal one is dodgy unless the index is younger than its last change."""
    return F.when((hygiene == "dirty") | ~same_metadata, "dirty").when(index_time <= modified, "dodgy").otherwise("clean")


def cached_if_clean(hygiene: Column, cached: Column) -> Column:
    return F.when(hygiene == "clean", cached)
