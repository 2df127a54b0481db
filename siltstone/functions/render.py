"""Commits, changes and status lines as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_time(seconds: Column, offset_s: Column) -> Column:
    """``2018-02-12 10:20:30 +00:00``."""
    local = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(secs=(seconds + offset_s).cast("decimal(18,6)"))
    minutes = F.floor(F.abs(offset_s) / 60)
    pad = lambda n: F.lpad(n.cast("string"), 2, "0")
    zone = F.concat(F.when(offset_s < 0, "-").otherwise("+"), pad(F.floor(minutes / 60)), F.lit(":"), pad(minutes % 60))
    return F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss "), zone)


def commit_text(digest_hex: Column, name: Column, mbox: Column, seconds: Column, offset_s: Column, message: Column) -> Column:
    """What a log shows of a commit; an author's name and address are told as far as known."""
    address = F.concat(F.lit("<"), mbox, F.lit(">"))
    author = F.when(name.isNotNull() | mbox.isNotNull(), F.concat(F.lit("author "), F.concat_ws(" ", name, address), F.lit("\n"))).otherwise("")
    said = F.coalesce(F.concat(F.lit("\t"), message, F.lit("\n")), F.lit(""))
    return F.concat(F.lit("commit "), digest_hex, F.lit("\n"), author, F.lit("date "), local_time(seconds, offset_s), F.lit("\n"), said)


def change_text(change: Column, path: Column) -> Column:
    return F.concat(F.initcap(change), F.lit("("), F.array_join(path, "/"), F.lit(")"))


def status_header(head: Column, candidate: Column) -> Column:
    """The first line of a status; head is ``branch x`` or ``commit y`` or null, candidate a short digest or null."""
    return (
        F.when(head.isNotNull() & candidate.isNotNull(), F.concat(F.lit("On "), head, F.lit(" with virtual workspace "), candidate))
        .when(head.isNotNull(), F.concat(F.lit("On "), head, F.lit(" without any virtual workspace")))
        .when(candidate.isNotNull(), F.concat(F.lit("No prior commit with virtual workspace "), candidate))
        .otherwise("No prior commit or virtual workspace")
    )
