"""Best-two-fit packing of tokenised documents into fixed-length sequences.

A bin is filled greedily with the longest document that still fits.  Then its
smallest document is taken out and replaced by the two unpacked documents that
fill the widened gap most, if together they are longer than it; this repeats
while it helps.

A bin depends only on how many documents of each length are left, so bins are
planned on the histogram of lengths, which has at most ``seq_len`` rows however
many documents there are.  The same bin is planned once with the number of
times it repeats.  Documents get their place by their rank among those of their
length: the text is read once and never shuffled.

Defined results: a null or empty text is the end id alone; a text of more than
``seq_len`` ids is cut into full pieces and a last, shorter one; repeated rows
are packed each; documents of equal length are interchangeable, their order is
that of the input's partitions; an empty table gives no rows.  Only ``doc_id``
and ``text`` are read, so other columns may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import narrow_batches, write_table
from siltstone.llm.tokens import encoder

END_ID = 0


def end_marked(ids: np.ndarray, first: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts side by side with the end id after each, and where each begins."""
    n = len(first) - 1
    begins = first + np.arange(n + 1)
    out = np.full(int(begins[-1]), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[begins[1:] - 1] = False
    out[keep] = ids
    return out, begins


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, seq_len: int, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and its partition and rank there among its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        seen = np.zeros(seq_len + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            ids_of = batch.column(0)
            for slab, e in enc.encode(batch.column(1)):
                ids, begins = end_marked(e.ids, e.first, end_id)
                total = np.diff(begins)
                n = -(-total // seq_len)
                owner = np.repeat(np.arange(len(total)), n)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * seq_len
                length = np.minimum(total[owner] - start, seq_len)
                raw, at = memoryview(ids).cast("B"), begins[owner] + start
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                run_start = np.searchsorted(length[order], length[order])
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - run_start
                rank += seen[length]
                seen += np.bincount(length, minlength=seq_len + 1)
                yield pa.RecordBatch.from_arrays(
                    [ids_of.slice(slab.first, len(slab)).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(owner), part, np.int32)), pa.array(rank)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "part_rank"],
                )

    narrow_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, part_rank long")


def plan_bins(counts: np.ndarray, seq_len: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (repeats, [(length, documents of it)]) for ``counts[l]`` documents of each length l."""
    left = np.asarray(counts, np.int64).copy()
    bins: list[tuple[int, list[tuple[int, int]]]] = []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return bins
        used: dict[int, int] = {}
        gap = seq_len
        i = len(there) - 1
        while gap and i >= 0:
            i = min(i, int(np.searchsorted(there, gap, "right")) - 1)
            if i < 0:
                break
            length = int(there[i])
            take = min(gap // length, int(left[length]))
            used[length] = take
            gap -= take * length
            i -= 1
        while gap and used:
            smallest = min(used)
            pair = _best_two(left, used, gap + smallest)
            if pair is None or sum(pair) <= smallest:
                break
            used[smallest] -= 1
            if not used[smallest]:
                del used[smallest]
            for length in pair:
                used[length] = used.get(length, 0) + 1
            gap += smallest - sum(pair)
        repeats = min(int(left[length]) // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= repeats * n
        bins.append((repeats, sorted(used.items(), reverse=True)))


def _best_two(left: np.ndarray, used: dict[int, int], room: int) -> tuple[int, int] | None:
    """The two unpacked documents with the greatest total length up to ``room``."""
    free = left[: room + 1].copy()
    for length, n in used.items():
        if length <= room:
            free[length] -= n
    x = np.flatnonzero(free > 0)
    if not len(x):
        return None
    j = np.searchsorted(x, room - x, "right") - 1
    ok = j >= 0
    ok &= (j != np.arange(len(x))) | (free[x] > 1)
    if not ok.any():
        return None
    total = np.where(ok, x + x[np.maximum(j, 0)], -1)
    a = int(np.argmax(total))
    return int(x[a]), int(x[j[a]])


def _segments(bins: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length << 40 | first rank, first rank, first sequence, documents a bin, offset), sorted by the first."""
    next_rank: dict[int, int] = {}
    rows, sequence = [], 0
    for repeats, items in bins:
        offset = 0
        for length, n in items:
            lo = next_rank.get(length, 0)
            rows.append((length << 40 | lo, lo, sequence, n, offset))
            next_rank[length] = lo + repeats * n
            offset += length * n
        sequence += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = END_ID) -> DataFrame:
    """The place of every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = write_table(tokenized_pieces(docs, tokenizer_path, seq_len, end_id), "pieces")
    cells = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = write_table(cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "cells")
    counts = np.zeros(seq_len + 1, np.int64)
    for row in cells.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most seq_len rows
        counts[row["length"]] = row["n"]
    segments = _segments(plan_bins(counts, seq_len))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            row = segments[np.searchsorted(segments[:, 0], length << 40 | rank, "right") - 1]
            k, j = np.divmod(rank - row[:, 1], row[:, 3])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 2] + k), pa.array(row[:, 4] + j * length)], [*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = pieces.join(cells.select("part", "length", "before"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("part_rank") + F.col("before")).alias("rank"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and the doc_ids in order (needs distinct doc_ids)."""
    places = pack(docs, tokenizer_path, seq_len, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            start, length = batch["start"].to_numpy(), batch["length"].to_numpy()
            for slab, e in enc.encode(batch["text"]):
                ids, begins = end_marked(e.ids, e.first, end_id)
                rows = range(slab.first, slab.first + len(slab))
                values = [ids[begins[k] + start[i] : begins[k] + start[i] + length[i]] for k, i in enumerate(rows)]
                part = batch.slice(slab.first, len(slab))
                yield pa.RecordBatch.from_arrays([part["sequence_id"], part["offset"], part["doc_id"], pa.array(values, pa.list_(pa.int32()))], ["sequence_id", "offset", "doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = places.join(docs.select("doc_id", "text"), "doc_id").select("sequence_id", "offset", "doc_id", "start", "length", "text")
    rows = texts.mapInArrow(run, f"sequence_id long, offset long, doc_id {kind}, ids array<int>")
    in_order = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # a sequence holds seq_len ids at most
    return rows.groupBy("sequence_id").agg(in_order.alias("x")).select("sequence_id", F.flatten("x.ids").alias("ids"), F.col("x.doc_id").alias("doc_ids"))
