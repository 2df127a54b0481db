"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``vnodes`` points of a ring of 64-bit hashes; a row belongs to
the first point clockwise from the hash of its key.  Shards have capacities.
A full shard keeps the rows that come first on the ring within its arcs, and
the others continue clockwise to the next point whose shard has room.  With
``epsilon`` 0 capacities add up to the number of rows, and row counts are at
most one apart; a larger ``epsilon`` moves fewer rows when shards change.

Only the number of rows of each arc (shards x vnodes numbers) reaches the
driver, which plans where the overflow of each arc goes.  Rows get their shard
and slot by their rank within their arc.  The key of a row is its doc_id with
the size and checksum of its text, so rows of one doc_id, or of none, spread
over the ring; equal rows, of which there may be any number, are counted first,
ranked as one and told apart again in blocks.

Rows of equal texts have places of their own: the law is that of numbers of
rows, which no group of copies may upset.

Defined results: a null text has 0 bytes, so size 8, and crc32 0; a null key
hashes like any value; within an arc rows are ordered by place, doc_id, size and
checksum, equal rows in any order; an empty table gives no rows.  Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import write_table


#: Equal rows that are told apart at once.
BLOCK = 1 << 16


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Points of the ring in order, as signed 64-bit integers, and the shard of each."""
    points = sorted((int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "little", signed=True), s) for s in range(shards) for v in range(vnodes))
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int64)


def plan_arcs(rows: np.ndarray, owner: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """Segments (arc << 40 | first rank, first rank, shard, first slot) for the rows of each arc, sorted."""
    load = np.zeros(len(capacity), np.int64)
    out, over = [], []
    for arc, (n, s) in enumerate(zip(rows.tolist(), owner.tolist(), strict=True)):
        take = min(n, int(capacity[s] - load[s]))
        if take:
            out.append((arc << 40, 0, s, int(load[s])))
            load[s] += take
        if n > take:
            over.append((arc, take, n))
    for arc, rank, n in over:
        step = arc
        while rank < n:
            step = (step + 1) % len(owner)
            s = int(owner[step])
            take = min(n - rank, int(capacity[s] - load[s]))
            if take:
                out.append((arc << 40 | rank, rank, s, int(load[s])))
                load[s] += take
                rank += take
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def capacities(rows: int, shards: int, epsilon: float) -> np.ndarray:
    """Rows that each shard may hold: shares one apart at most, times 1 + epsilon, rounded up."""
    share = np.full(shards, rows // shards, np.int64)
    share[: rows % shards] += 1
    return share if not epsilon else np.ceil(share * (1 + epsilon)).astype(np.int64)


def assign(docs: DataFrame, shards: int, vnodes: int = 512, epsilon: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 within the shard) of every row."""
    points, owner = ring(shards, vnodes)

    def arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arc = np.searchsorted(points, batch["at"].to_numpy()) % len(points)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(arc.astype(np.int32))], [*batch.schema.names, "arc"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit("")).cast("binary")
    key = ["doc_id", "size", "text_crc32"]
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.groupBy(*key).agg(F.count("*").alias("n")).select(*key, "n", F.xxhash64(*key).alias("at"))
    rows = write_table(rows.mapInArrow(arcs, f"doc_id {kind}, size long, text_crc32 long, n long, at long, arc int"), "arcs")
    count = np.zeros(len(points), np.int64)
    for r in rows.groupBy("arc").agg(F.sum("n").alias("n")).collect():  # at most shards x vnodes rows
        count[r["arc"]] = r["n"]
    segments = plan_arcs(count, owner, capacities(int(count.sum()), shards, epsilon))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arc, rank = batch["arc"].to_numpy().astype(np.int64), batch["rank"].to_numpy().astype(np.int64)
            row = segments[np.searchsorted(segments[:, 0], arc << 40 | rank, "right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(row[:, 2].astype(np.int32)), pa.array(row[:, 3] + rank - row[:, 1])], [*key, "shard", "slot"])

    on_arc = Window.partitionBy("arc").orderBy("at", *key).rowsBetween(Window.unboundedPreceding, -1)
    first = rows.withColumn("rank", F.coalesce(F.sum("n").over(on_arc), F.lit(0)))
    ranked = _copies(first.where(F.col("n") <= BLOCK))
    if not rows.where(F.col("n") > BLOCK).isEmpty():
        blocks = first.where(F.col("n") > BLOCK).select(*key, "arc", "n", "rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BLOCK).cast("long"))).alias("from"))
        spread = blocks.repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1))
        ranked = ranked.unionByName(_copies(spread.withColumn("rank", F.col("rank") + F.col("from")).withColumn("n", F.least(F.lit(BLOCK).cast("long"), F.col("n") - F.col("from")))))
    return ranked.mapInArrow(place, f"doc_id {kind}, size long, text_crc32 long, shard int, slot long")


def _copies(rows: DataFrame) -> DataFrame:
    """Each of n equal rows with its own rank."""
    return rows.select("doc_id", "size", "text_crc32", "arc", F.explode(F.sequence("rank", F.col("rank") + F.col("n") - 1)).alias("rank"))
