"""Nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

Each of ``tables`` hash functions turns a unit vector by three rounds of random
signs and a Hadamard transform, and names the signed axis nearest to it.
Vectors of one axis share a bucket.  A query looks into the buckets of its
``probes`` nearest signed axes of each table, and what it finds there is
reranked by exact Euclidean distance of the original vectors in double
precision.

A bucket is one group of work: its queries stand first, its vectors stream past
them in batches, and only each query's ``k`` best vec_ids leave the task.  Buckets with
more than ``TASK_ROWS`` vectors or queries are cut into parts, each pair of
parts being a task, so that a hot bucket is spread and never gathered.  A task
compares ``CELLS`` pairs at once.  Vectors are moved in their stored type, once
for each table, so few tables with many probes move least.  Queries
that find fewer than ``k`` others look into every bucket of one table, so all
candidates are returned where there are no more.

Defined results: vectors that are null, zero or hold null or non-finite
components take no part, nor do those of another length than most vectors (the
lesser length if tied); a query is never its own neighbour, nor are other rows
with its vec_id; of rows that repeat a vec_id the nearest counts; ties go to
the smaller vec_id; an empty table gives no rows.  Only ``vec_id`` and
``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import write_table

TASK_ROWS = 50_000
#: Distances that a task holds at once.
CELLS = 1 << 22


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of rows, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    x = x.copy()
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


class CrossPolytope:
    """``tables`` pseudo-rotations of vectors of ``dim`` components, padded to a power of two."""

    def __init__(self, dim: int, tables: int, seed: int) -> None:
        self.dim, self.tables = dim, tables
        self.size = 1 << max(0, dim - 1).bit_length()
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, self.size))

    def turned(self, x: np.ndarray, table: int) -> np.ndarray:
        y = np.zeros((len(x), self.size))
        y[:, : self.dim] = x / np.linalg.norm(x, axis=1, keepdims=True)
        for sign in self.signs[table]:
            y = hadamard(y * sign)
        return y

    def axes(self, x: np.ndarray, table: int, probes: int) -> np.ndarray:
        """Each row's nearest signed axes, nearest first; axis i with a minus sign is size + i."""
        y = self.turned(x, table)
        both = np.concatenate((y, -y), 1)
        probes = min(probes, both.shape[1])
        if probes == 1:
            return both.argmax(1)[:, None]
        return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The rows that take part, with embeddings as floats or else doubles, and their length."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).where("vec_id is not null and embedding is not null and size(embedding) > 0")
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.where(good)
    top = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = top["d"] if top else 1
    return rows.where(F.size("embedding") == dim), dim


def _nearest(ids: np.ndarray, own: np.ndarray, distance: np.ndarray, k: int) -> np.ndarray:
    """Positions, by row, of the k least (distance, id), without those with the row's own id."""
    distance = np.where(ids == own[:, None], np.inf, distance)
    if distance.shape[1] > 4 * k:
        # Everything at or below the k-th least distance, ties included.
        limit = np.partition(distance, k - 1, axis=1)[:, k - 1]
        width = int((distance <= limit[:, None]).sum(1).max())
        if width <= 4 * k:
            near = np.argpartition(distance, width - 1, axis=1)[:, :width]
            order = np.lexsort((np.take_along_axis(np.broadcast_to(ids, distance.shape), near, 1), np.take_along_axis(distance, near, 1)), axis=1)
            return np.take_along_axis(near, order[:, :k], 1)
    order = np.lexsort((np.broadcast_to(ids, distance.shape), distance), axis=1)
    return order[:, :k]


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances from differences, so that equal vectors are at 0 exactly; in blocks."""
    out = np.empty((len(q), len(x)))
    step = max(1, (1 << 21) // max(1, x.size))
    for i in range(0, len(q), step):
        out[i : i + step] = np.sqrt(((q[i : i + step, None, :] - x[None]) ** 2).sum(2))
    return out


def _distinct(ids: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and each query's least distance to one of their rows."""
    names, inverse = np.unique(ids, return_inverse=True)
    if len(names) == len(ids):
        return ids, distance
    order = np.argsort(inverse, kind="stable")
    return names, np.minimum.reduceat(distance[:, order], np.searchsorted(inverse[order], np.arange(len(names))), axis=1)


def scan(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by task, queries first: each query's k nearest vec_ids of its task, each by its nearest row."""
    key, queries, best = None, None, None

    def done() -> Iterator[pa.RecordBatch]:
        if best is not None:
            ids, scores = best
            own = np.repeat(queries[0], ids.shape[1])
            keep = np.isfinite(scores.reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(own[keep]), pa.array(ids.reshape(-1)[keep]), pa.array(scores.reshape(-1)[keep])], ["query_id", "vec_id", "score"])

    for batch in batches:
        task, query, ids, x = batch["task"].to_numpy(), batch["is_query"].to_numpy(zero_copy_only=False).astype(bool), batch["vec_id"].to_numpy(), _vectors(batch["embedding"], dim)
        edges = np.flatnonzero(np.concatenate(([True], (task[1:] != task[:-1]) | (query[1:] != query[:-1]), [True]))) if len(task) else []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if task[lo] != key:
                yield from done()
                key, queries, best = task[lo], None, None
            if query[lo]:
                more = (ids[lo:hi], x[lo:hi])
                queries = more if queries is None else tuple(np.concatenate(z) for z in zip(queries, more, strict=True))
            elif queries is not None:
                step = max(1, min(2048, CELLS // len(queries[0])))
                for at in range(lo, hi, step):
                    part = slice(at, min(hi, at + step))
                    names, distance = _distinct(ids[part], _distances(queries[1], x[part]))
                    near = _nearest(names[None], queries[0], distance, k)
                    found, scores = names[near], np.take_along_axis(np.where(names[None] == queries[0][:, None], np.inf, distance), near, 1)
                    if best is not None:
                        found, scores = np.concatenate((best[0], found), 1), np.concatenate((best[1], scores), 1)
                        order = np.lexsort((scores, found), axis=1)
                        found, scores = np.take_along_axis(found, order, 1), np.take_along_axis(scores, order, 1)
                        scores[:, 1:][found[:, 1:] == found[:, :-1]] = np.inf  # a farther row of the same vec_id
                        order = np.lexsort((found, scores), axis=1)[:, :k]
                        found, scores = np.take_along_axis(found, order, 1), np.take_along_axis(scores, order, 1)
                    best = found, scores
    yield from done()


def _search(rows: DataFrame, queries: DataFrame, hashes: CrossPolytope, dim: int, k: int, tables: int, probes: int) -> DataFrame:
    buckets = tables * 2 * hashes.size

    def codes(count: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _vectors(batch["embedding"], dim)
                if len(x):
                    bucket = np.concatenate([hashes.axes(x, t, count) + t * 2 * hashes.size for t in range(tables)], 1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(bucket), pa.list_(pa.int32()))], [*batch.schema.names, "buckets"])

        return run

    kind = rows.schema["embedding"].dataType.simpleString()
    schema = f"vec_id long, embedding {kind}, buckets array<int>"
    stored = write_table(rows.mapInArrow(codes(1), schema), "hashed")
    asked = write_table(queries.mapInArrow(codes(probes), schema), "probes")
    parts = np.ones((2, buckets), np.int64)
    for i, side in enumerate((stored, asked)):
        for r in side.select(F.explode("buckets").alias("b")).groupBy("b").count().collect():  # at most tables x 2 x size rows
            parts[i, r["b"]] = -(-r["count"] // TASK_ROWS)

    def deal(side: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                # A row is in one part of its bucket's own side and meets every part of the other.
                ids = batch["vec_id"].to_numpy()
                bucket = batch["buckets"].flatten().to_numpy()
                width = len(bucket) // max(1, len(ids))
                owner = np.repeat(np.arange(len(ids)), width)
                mine = (ids[owner].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % parts[side, bucket]
                times = parts[1 - side, bucket]
                owner, bucket, mine = (np.repeat(z, times) for z in (owner, bucket, mine))
                other = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
                x, y = (mine, other) if side == 0 else (other, mine)
                task = (x * parts[1, bucket] + y) * buckets + bucket
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(np.full(len(owner), side == 1)), batch["vec_id"].take(at), batch["embedding"].take(at)], ["task", "is_query", "vec_id", "embedding"])

        return run

    dealt = f"task long, is_query boolean, vec_id long, embedding {kind}"
    work = stored.mapInArrow(deal(0), dealt).unionByName(asked.mapInArrow(deal(1), dealt))
    work = work.repartition("task").sortWithinPartitions("task", F.desc("is_query"))
    found = work.mapInArrow(lambda b: scan(b, dim, k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, is_query: Column, k: int = 10, tables: int = 8, probes: int = 14, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for the rows that ``is_query`` holds for, among all rows."""
    rows, dim = usable(vectors)
    queries = rows.where(is_query)
    hashes = CrossPolytope(dim, tables, seed)
    found = write_table(_search(rows, queries, hashes, dim, k, tables, probes), "neighbours")
    full = found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = write_table(queries.join(full, "vec_id", "left_anti"), "short")
    if short.isEmpty():
        return found
    every = _search(rows, short, hashes, dim, k, 1, 2 * hashes.size)
    return found.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(every)
