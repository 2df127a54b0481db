"""Content-defined chunking.

A cut is allowed after a stride where the sum of the last ``window`` bytes has
the remainder ``marker`` modulo 2^``log2_modulus``.  Wherever a chunk may end,
the window lies wholly inside it, so the sums do not depend on earlier cuts:
candidates are found in parallel, and only the choice among them (the next one
at least ``window`` bytes on) is made in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.sources.tables import write_scratch


@dataclass(frozen=True)
class Parameters:
    """The defaults are fixed values: stride 1, window 8192 strides, modulus 2^14, marker 1."""

    stride: int = 1
    strides_per_window: int = 8192
    log2_modulus: int = 14
    marker: int = 1

    @property
    def window(self) -> int:
        return self.stride * self.strides_per_window

    @property
    def modulus(self) -> int:
        return 1 << self.log2_modulus


def candidates(data: np.ndarray, p: Parameters, before: np.ndarray | None = None) -> np.ndarray:
    """Ends at which a cut is allowed; ``before`` holds window bytes that precede the data, if there are any."""
    lead = 0 if before is None else len(before)
    data = data if before is None else np.concatenate((before, data))
    total = np.concatenate(([0], np.cumsum(data, dtype=np.int64)))
    w = p.window
    if len(data) < w:
        return np.zeros(0, np.int64)
    ends = np.flatnonzero((total[w:] - total[:-w]) % p.modulus == p.marker % p.modulus) + w - lead
    return ends[ends > 0]


def choose(ends: np.ndarray, window: int, last: int = 0) -> list[int]:
    """The cuts: each the first candidate at least ``window`` after the one before."""
    cuts = []
    at = int(np.searchsorted(ends, last + window))
    while at < len(ends):
        last = int(ends[at])
        cuts.append(last)
        at = int(np.searchsorted(ends, last + window))
    return cuts


def split(data: bytes | np.ndarray, p: Parameters) -> list[tuple[int, int]]:
    """All ranges, the last partial one included; it is empty if the data ends on a cut or is empty."""
    data = np.frombuffer(data, np.uint8) if isinstance(data, bytes | bytearray | memoryview) else data
    ends = candidates(data, p)
    cuts = choose(ends[ends % p.stride == 0], p.window)
    return list(zip([0, *cuts], [*cuts, len(data)], strict=True))


def split_before(data: bytes | np.ndarray, window: int = 8192, log2_modulus: int = 14, marker: int = 1) -> list[tuple[int, int]]:
    """The older variant: the cut stands before the byte that completes the sum, more than ``window`` bytes on; no empty ranges."""
    data = np.frombuffer(data, np.uint8) if isinstance(data, bytes | bytearray | memoryview) else data
    ends = candidates(data, Parameters(1, window, log2_modulus, marker)) - 1
    cuts, last = [], 0
    while True:
        at = int(np.searchsorted(ends, last + window))
        if at == len(ends):
            break
        last = int(ends[at])
        cuts.append(last)
    return [(a, b) for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True) if b > a]


def group_items(signatures: np.ndarray, minimum: int = 32, window: int = 4, log2_modulus: int = 7, marker: int = 1) -> list[tuple[int, int]]:
    """Ranges of items: a group ends with an item where the last ``window`` signatures of the group sum to the marker, beyond ``minimum`` items."""
    total = np.concatenate(([0], np.cumsum(signatures, dtype=np.int64)))
    n, start, out = len(signatures), 0, []
    while start < n:
        i = np.arange(start + max(minimum, window - 1), n)
        hit = np.flatnonzero((total[i + 1] - total[i + 1 - window]) % (1 << log2_modulus) == marker)
        end = int(i[hit[0]]) + 1 if len(hit) else n
        out.append((start, end))
        start = end
    return out


def hierarchy(signatures: list[int], limit: int = 1024) -> list[list[tuple[int, int]]]:
    """Levels of groups until at most ``limit`` remain; a group's signature is the sum of its items'."""
    levels = []
    now = np.asarray(signatures, np.int64)
    while len(now) > limit:
        groups = group_items(now)
        levels.append(groups)
        now = np.array([now[a:b].sum() % 256 for a, b in groups])
    return levels


def signature8(digest: Column | str) -> Column:
    """The 8-bit signature of a chunk: its digest's first byte."""
    return F.conv(F.substring(F.hex(digest), 1, 2), 16, 10).cast("int")


def group_rows(df: DataFrame, keys: list[str], order: str, signature: str, minimum: int = 32, window: int = 4, log2_modulus: int = 7, marker: int = 1) -> DataFrame:
    """The rows with ``group``, from 0 in each stream given by keys: ``group_items`` as a dataflow.

    No two rows of a stream should share their place in ``order``.  Rows are dealt
    by ranges, so a stream may be in many tasks.  Each finds the rows inside its
    pieces where a group may end; only those, and the signatures of a window at
    the pieces' edges, pass by in order.  What they choose for a piece goes back to it.
    """
    least, edge = max(minimum, window - 1) + 1, window - 1
    modulus, marker = 1 << log2_modulus, marker % (1 << log2_modulus)
    named = df.select(F.struct(*keys).alias("_stream"), F.col(order).alias("_order"), F.struct(*df.columns).alias("_row"), F.coalesce(F.col(signature).cast("long"), F.lit(0).cast("long")).alias("_signature"))
    dealt = named.repartitionByRange("_stream", "_order").sortWithinPartitions("_stream", "_order").withColumn("_part", F.spark_partition_id())
    dealt = write_scratch(dealt, "ranges")  # where the bounds fall is settled once
    in_order = Window.partitionBy("_part", "_stream").orderBy("_order")
    rows = dealt.withColumn("_at", F.row_number().over(in_order).cast("long"))
    total = F.sum("_signature").over(in_order.rowsBetween(-edge, 0))
    rows = rows.withColumn("_hit", (F.col("_at") >= window) & (F.pmod(total, F.lit(modulus)) == marker))
    size = F.count("*").over(Window.partitionBy("_part", "_stream"))
    rows = write_scratch(rows.withColumn("_size", size).select("_part", "_stream", "_at", "_row", "_signature", "_hit", "_size"), "ranges")
    kept = rows.where(F.col("_hit") | (F.col("_at") <= edge) | (F.col("_at") > F.col("_size") - edge) | (F.col("_at") == 1))
    stream = df.select(F.struct(*keys).alias("_stream")).schema["_stream"].dataType.simpleString()

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, part = None, None
        before, offset, size, last, group = [], 0, 0, 0, 0

        for batch in batches:
            out: list[tuple[int, int, int, int]] = []  # row of the batch, part, the place after which the group holds, group
            names = batch["_stream"].to_pylist()
            columns = (batch[c].to_pylist() for c in ("_part", "_at", "_signature", "_hit", "_size"))
            for i, (name, p, at, value, hit, n) in enumerate(zip(names, *columns, strict=True)):
                if name != stream:
                    stream, part, before, offset, size, last, group = name, None, [], 0, 0, 0, 0
                if p != part:
                    part, offset, size = p, offset + size, n
                    out.append((i, p, 0, group))
                if at <= edge:  # its window begins in pieces before
                    hit = offset + at >= window and (sum(before[len(before) - edge :]) + value if edge else value) % modulus == marker
                if edge and (at <= edge or at > n - edge):
                    before = [*before, value][-edge:]
                if hit and offset + at - last >= least:
                    last, group = offset + at, group + 1
                    out.append((i, p, at, group))
            if out:
                own = [pa.array(c, k) for c, k in zip(list(zip(*out, strict=True))[1:], (pa.int32(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch["_stream"].take(pa.array([x[0] for x in out], pa.int64())), *own], ["_stream", "_part", "_after", "_group"])

    passing = kept.select("_stream", "_part", "_at", "_signature", "_hit", "_size").repartition("_stream").sortWithinPartitions("_stream", "_part", "_at")
    cuts = passing.mapInArrow(chosen, f"_stream {stream}, _part int, _after long, _group long")
    # A cut is a row after the row it follows; each row takes the group of the last cut before it.
    places = rows.select("_part", "_stream", F.col("_at"), F.lit(1).alias("_side"), "_row", F.lit(None).cast("long").alias("_group"))
    starts = cuts.select("_part", "_stream", F.col("_after").alias("_at"), F.lit(2).alias("_side"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_group")
    met = Window.partitionBy("_part", "_stream").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = places.unionByName(starts).withColumn("_group", F.last("_group", ignorenulls=True).over(met)).where("_side = 1")
    return out.select("_row.*", F.col("_group").alias("group"))


def chunks(df: DataFrame, keys: list[str], data: str, p: Parameters = Parameters(), keep_empty: bool = True) -> DataFrame:
    """keys, ordinal, start, end of every chunk of the BINARY column ``data`` (null: no rows).

    Narrow: no shuffle.  ``keep_empty``: whether a last empty range stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, ordinal, start, end = [], [], [], []
            for i, raw in enumerate(batch.column(len(keys))):
                view = raw.as_buffer()
                if view is None:
                    continue
                ranges = split(np.frombuffer(view, np.uint8), p)
                if not keep_empty and len(ranges) > 1 and ranges[-1][0] == ranges[-1][1]:
                    ranges.pop()
                owner += [i] * len(ranges)
                ordinal += range(len(ranges))
                start += [a for a, _ in ranges]
                end += [b for _, b in ranges]
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys))), pa.array(ordinal, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], [*keys, "ordinal", "start", "end"])

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, F.col(data).cast("binary").alias(data)).mapInArrow(run, f"{schema}, ordinal int, start long, end long")


def chunk_blobs(df: DataFrame, keys: list[str], data: str, p: Parameters = Parameters()) -> DataFrame:
    """keys, ordinal, start, end, blob: the chunks with their bytes, without a last empty one beside others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, ordinal, start, end, blobs = [], [], [], [], []
            for i, raw in enumerate(batch.column(len(keys))):
                view = raw.as_buffer()
                if view is None:
                    continue
                found = split(np.frombuffer(view, np.uint8), p)
                if len(found) > 1 and found[-1][0] == found[-1][1]:
                    found.pop()
                for k, (a, b) in enumerate(found):
                    owner.append(i)
                    ordinal.append(k)
                    start.append(a)
                    end.append(b)
                    blobs.append(memoryview(view)[a:b])
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys))), pa.array(ordinal, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array([bytes(b) for b in blobs], pa.binary())], [*keys, "ordinal", "start", "end", "blob"])

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, F.col(data).cast("binary").alias(data)).mapInArrow(run, f"{schema}, ordinal int, start long, end long, blob binary")


def long_chunks(df: DataFrame, keys: list[str], order: str, data: str, p: Parameters = Parameters()) -> DataFrame:
    """keys, ordinal, start, end of the chunks of streams that come as rows, whatever their length.

    A stream is the ``data`` of the rows of a key in ascending ``order``, which
    no two of its rows should share; null data has no bytes; only an empty
    stream has an empty chunk.  Rows are dealt by ranges, so a stream may be
    in many tasks.  Each finds the candidates inside its pieces; their edges,
    a window long, meet where the few candidates of a stream pass by in order.
    """
    types = [to_arrow_type(df.schema[k].dataType) for k in keys]
    edge, schema = p.window - 1, ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
        named = list(zip(*(batch.column(i).to_pylist() for i in range(len(keys))), strict=True))
        a = 0
        for b in range(1, len(named) + 1):
            if b == len(named) or named[b] != named[a]:
                yield named[a], a, b
                a = b

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            at, rows = [], []
            for _, a, b in runs(batch):
                raw = b"".join(x.as_buffer() for x in batch.column(len(keys)).slice(a, b - a) if x.is_valid)
                at.append(a)
                rows.append((part, seq, len(raw), raw[:edge], raw[max(0, len(raw) - edge) :], candidates(np.frombuffer(raw, np.uint8), p)))
                seq += 1
            own = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            found = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(own), own, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(keys))), *found], [*keys, "_part", "_seq", "_size", "_head", "_tail", "_ends"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        before, offset, last, ordinal = b"", 0, 0, 0
        names = [*keys, "ordinal", "start", "end"]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*types, *[pa.int64()] * 3], strict=True)], names)

        for batch in batches:
            rows = []
            size, head, tail, ends = (batch.column(len(keys) + i) for i in (2, 3, 4, 5))
            for name, a, b in runs(batch):
                if name != now:
                    if now is not None and (last < offset or not ordinal):
                        rows.append((*now, ordinal, last, offset))
                    now, before, offset, last, ordinal = name, b"", 0, 0, 0
                for i in range(a, b):
                    over = candidates(np.frombuffer(head[i].as_py(), np.uint8), p, np.frombuffer(before, np.uint8))
                    met = np.concatenate((over, ends[i].values.to_numpy())) + offset
                    for cut in choose(met[met % p.stride == 0], p.window, last):
                        rows.append((*now, ordinal, last, cut))
                        last, ordinal = cut, ordinal + 1
                    offset += size[i].as_py()
                    kept = before + tail[i].as_py()
                    before = kept[max(0, len(kept) - edge) :]
            if rows:
                yield made(rows)
        if now is not None and (last < offset or not ordinal):
            yield made([(*now, ordinal, last, offset)])

    rows = df.select(*keys, F.col(order).alias("_order"), F.col(data).cast("binary").alias("_data"))
    dealt = rows.repartitionByRange(*keys, "_order").sortWithinPartitions(*keys, "_order").drop("_order")
    found = dealt.mapInArrow(pieces, f"{schema}, _part int, _seq long, _size long, _head binary, _tail binary, _ends array<long>")
    return found.repartition(*keys).sortWithinPartitions(*keys, "_part", "_seq").mapInArrow(joined, f"{schema}, ordinal long, start long, end long")


def candidate_ends(df: DataFrame, keys: list[str], data: str, p: Parameters) -> DataFrame:
    """keys, end of every candidate, by SQL windows over single bytes; the kernel's plain counterpart."""
    hexed = F.hex(F.col(data).cast("binary"))
    bytes_ = df.select(*keys, F.posexplode(F.regexp_extract_all(hexed, F.lit("(..)"), F.lit(1))).alias("pos", "h")).select(*keys, (F.col("pos") + 1).alias("end"), F.conv("h", 16, 10).cast("long").alias("v"))
    w = Window.partitionBy(*keys).orderBy("end").rowsBetween(-(p.window - 1), 0)
    hit = (F.pmod(F.sum("v").over(w), F.lit(p.modulus)) == p.marker) & (F.col("end") >= p.window) & (F.col("end") % p.stride == 0)
    return bytes_.withColumn("hit", hit).where("hit").select(*keys, F.col("end").cast("long").alias("end"))


def chosen_cuts(ends: Column, window: int) -> Column:
    """The cuts among an ascending array of candidate ends, as a fold within the engine."""
    first = F.array(F.lit(0).cast("long"))
    return F.aggregate(ends, first, lambda cuts, e: F.when(e - F.element_at(cuts, -1) >= window, F.array_append(cuts, e)).otherwise(cuts), lambda cuts: F.slice(cuts, F.lit(2), F.size(cuts)))
