"""Near-duplicate classes by bottom-k sketches of one hash function.

1. Every text's set of word shingles is hashed once; the ``k`` least hashes are
   its sketch.  Texts with equal sets are one class from here on.  A shingle is
   known by 128 bits of its hash, of which the sketch has the first half.
2. Inverted lists of the retained values: two sets with similarity t share at
   least c sketch values but with a probability under 1e-7 (c from the binomial
   tail).  So each class looks only into the lists of its k - c + 1 rarest
   values, and any such pair still meets in one.  A very frequent passage
   costs nothing unless it makes up most of a sketch.
3. Classes that meet in a list are tied to the list's least member; what hangs
   together is a family.  A family is compared within one task, or, beyond
   ``BLOCK_SHINGLES``, in tasks for each pair of its blocks by size.
4. Within a task, a flood from each class compares it with the classes not yet
   reached: those whose sketches share fewer than the same c values are dropped
   (the same event, so a pair is missed with probability under 1e-7 in all),
   exact Jaccard on the full sets decides on the rest.  Only links that join something new
   are emitted, so a group of m classes gives under m links, not m * m / 2.
5. Components of the links, by joins; the least doc_id names a component.

Defined results: null and empty texts and texts of white space have no set and
are linked with nothing; texts with fewer words than a shingle have one shingle,
all of them; equal texts are linked always; a row without doc_id takes its
component's, and links others as any row does; a component in which no row has a
doc_id is null; an empty table gives no rows.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.components import components, split_join
from siltstone.llm.shared import narrow_batches, write_table
from siltstone.llm.words import shingle_hashes, slabs, span_digests, words

#: Shingle hashes of a block of a large family; a task holds two blocks at most.
BLOCK_SHINGLES = 500_000
_MISS = 1e-7


def shingle_sets(column: pa.Array, width: int) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """The distinct shingles of each text, by slabs: the two halves of their 128-bit hashes, ascending by the first."""
    for slab in slabs(column):
        w = words(slab)
        low, high = (shingle_hashes(x, w.first, width) for x in span_digests(slab.data, w.starts, w.ends))
        yield [_distinct(low[0][a:b], high[0][a:b]) for a, b in zip(low[1][:-1].tolist(), low[1][1:].tolist(), strict=True)]


def _order(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by 128-bit numbers, and which of them in it differ from the one before (but for the first)."""
    order = np.argsort(low, kind="stable")
    x, y = low[order], high[order]
    new = x[1:] != x[:-1]
    if (~new & (y[1:] != y[:-1])).any():
        order = np.lexsort((high, low))
        x, y = low[order], high[order]
        new = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return order, new


def _distinct(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(low):
        return low, high
    order, new = _order(low, high)
    order = order[np.concatenate(([True], new))]
    return low[order], high[order]


@functools.lru_cache(maxsize=1024)
def least_overlap(k: int, t: float, miss: float = _MISS) -> int:
    """The greatest c for which sketches of sets with similarity t share fewer than c values with probability under ``miss``."""
    total, c = 0.0, 0
    while c < k:
        total += math.comb(k, c) * t**c * (1 - t) ** (k - c)
        if total > miss:
            break
        c += 1
    return max(1, c)


def signatures(docs: DataFrame, k: int, width: int) -> DataFrame:
    """row, doc_id, n_shingles, cls (16 bytes naming the set; null without one) and sketch, of docs (row, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column(2), width):
                cls = [xxhash.xxh3_128_digest(low.tobytes() + high.tobytes()) if len(low) else None for low, high in sets]
                sketch = pa.array([low[:k].view(np.int64) for low, _ in sets], pa.list_(pa.int64()))
                own = [batch.column(i).slice(at, len(sets)) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array([len(low) for low, _ in sets], pa.int64()), pa.array(cls, pa.binary()), sketch], ["row", "doc_id", "n_shingles", "cls", "sketch"])
                at += len(sets)

    narrow_batches(docs.sparkSession)
    return docs.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, cls binary, sketch array<long>")


def candidate_edges(classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Edges (a, b) from the inverted lists, such that similar classes hang together."""
    c = least_overlap(k, num / den)
    postings = classes.select("cls", "n_shingles", F.explode("sketch").alias("v"))
    lists = postings.groupBy("v").agg(F.count("*").alias("f")).where("f > 1")
    shared = split_join(postings, lists, "v").groupBy("cls", "n_shingles").agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("found"))  # k at most
    n = F.col("n_shingles")
    need = F.when(n <= k * num // den, F.floor((n * num + den - 1) / den)).otherwise(c)
    # Of held values, held - need + 1 are looked up, rarest first; those in no other sketch are the rarest.
    places = (F.size("found") - need + 1).cast("int")
    rare = shared.where(places > 0).select("cls", F.explode(F.slice("found", F.lit(1), places)).alias("x")).select("cls", F.col("x.v").alias("v"))
    rare = write_table(rare, "rare")
    tied = rare.groupBy("v").agg(F.min("cls").alias("b"), F.count("*").alias("f")).where("f > 1").select("v", "b")
    return split_join(rare, tied, "v").select(F.col("cls").alias("a"), "b").where("a <> b").distinct()


def flood(sets: list[tuple[np.ndarray, np.ndarray]], side: np.ndarray | None, k: int, num: int, den: int) -> list[tuple[int, int]]:
    """Links that span the similar sets, which are in ascending order of size.

    side: if given, only sets of different sides are compared.
    """
    m = len(sets)
    sizes = np.array([len(low) for low, _ in sets], np.int64)
    order, new = _order(np.concatenate([low for low, _ in sets]), np.concatenate([high for _, high in sets]))
    ids = np.empty(len(order), np.int32)
    ids[order] = np.concatenate(([0], np.cumsum(new)))
    first = np.concatenate(([0], np.cumsum(sizes)))
    absent = int(new.sum()) + 1
    sketch = np.full((m, k), absent, np.int32)
    for i in range(m):
        part = ids[first[i] : first[i] + min(k, sizes[i])]
        sketch[i, : len(part)] = part
    last = np.where(sizes > k, sketch[:, -1], absent)
    mark = np.zeros(absent + 1, bool)
    sketched = np.zeros(absent + 1, bool)
    # A pair that meets in the inverted lists shares as many values as this asks for, so nothing more is lost here.
    need = np.array([1, *(least_overlap(n, num / den) for n in range(1, k + 1))])
    free = np.ones(m, bool)
    links: list[tuple[int, int]] = []
    for root in range(m):
        if not free[root]:
            continue
        free[root] = False
        stack = [root]
        while stack:
            u = stack.pop()
            lo = int(np.searchsorted(sizes, -(-sizes[u] * num // den)))
            hi = int(np.searchsorted(sizes, sizes[u] * den // num, "right"))
            near = np.flatnonzero(free[lo:hi]) + lo
            if side is not None:
                near = near[side[near] != side[u]]
            if not len(near):
                continue
            own = sketch[u][sketch[u] < absent]
            sketched[own] = True
            theirs = sketch[near]
            both = sketched[theirs].sum(1)
            cut = np.minimum(last[near], last[u])
            union = np.searchsorted(own, cut, "right") + ((theirs <= cut[:, None]) & (theirs < absent)).sum(1) - both
            sketched[own] = False
            near = near[both >= need[np.minimum(union, k)]]
            if not len(near):
                continue
            mark[ids[first[u] : first[u + 1]]] = True
            n = sizes[near]
            ends = np.cumsum(n)
            flat = np.repeat(first[near] - (ends - n), n) + np.arange(ends[-1])
            shared = np.add.reduceat(mark[ids[flat]].astype(np.int64), ends - n)
            mark[ids[first[u] : first[u + 1]]] = False
            found = near[den * shared >= num * (n + sizes[u] - shared)]
            free[found] = False
            links.extend((u, int(v)) for v in found)
            stack.extend(found.tolist())
    return links


def family_links(docs: DataFrame, classes: DataFrame, families: DataFrame, k: int, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between classes of a family with exact similarity num / den or more."""
    members = families.select(F.col("node").alias("cls"), F.col("component").alias("family")).join(classes.select("cls", "first.row", "n_shingles"), "cls")
    # Blocks follow the sizes, by running sums over the distinct sizes of a family; a size of many members has blocks of its own.
    weight = F.sum(F.col("n_shingles") + 64)
    before = Window.partitionBy("family").orderBy("n_shingles").rowsBetween(Window.unboundedPreceding, -1)
    sizes = members.groupBy("family", "n_shingles").agg(weight.alias("w"))
    sizes = sizes.withColumn("first", F.floor(F.coalesce(F.sum("w").over(before), F.lit(0)) / BLOCK_SHINGLES)).withColumn("parts", F.ceil(F.col("w") / BLOCK_SHINGLES))
    block = F.col("first") + F.pmod(F.xxhash64("cls"), F.col("parts"))
    members = write_table(members.join(sizes, ["family", "n_shingles"]).select("cls", "family", "row", "n_shingles", block.alias("block")), "members")
    blocks = members.groupBy("family", "block").agg(F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"))
    x, y = blocks.select("family", F.col("block").alias("i"), "hi"), blocks.select("family", F.col("block").alias("j"), "lo")
    pairs = x.join(y, "family").where(f"i <= j and hi * {den} >= lo * {num}").select("family", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    work = members.join(pairs, ["family", "block"]).groupBy("cls", "row", "family").agg(F.collect_list(F.struct("i", "j", "block")).alias("tasks"))  # a task for each block that its own meets
    texts = docs.select("row", "text").join(work, "row").select("text", "cls", "family", "tasks")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column(0), width):
                rest = batch.slice(at, len(sets))
                at += len(sets)
                yield pa.RecordBatch.from_arrays([pa.array([len(low) for low, _ in sets], pa.int64()), pa.array([low.tobytes() + high.tobytes() for low, high in sets], pa.binary()), *rest.columns[1:]], ["n", "shingles", "cls", "family", "tasks"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, sets, side in _tasks(batches):
            links = flood(sets, side, k, num, den) if len(sets) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([names[u] for u, _ in links], pa.binary()), pa.array([names[v] for _, v in links], pa.binary())], ["a", "b"])

    sets = texts.mapInArrow(to_sets, "n long, shingles binary, cls binary, family binary, tasks array<struct<i: long, j: long, block: long>>")
    dealt = sets.select("n", "shingles", "cls", "family", F.explode("tasks").alias("t")).select("family", "t.i", "t.j", "t.block", "n", "cls", "shingles")
    dealt = dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "n", "cls")
    return dealt.mapInArrow(compare, "a binary, b binary")


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[tuple[np.ndarray, np.ndarray]], np.ndarray | None]]:
    """Rows sorted by task, as one group each: names, sets, and the sides if there are two."""
    key, names, sets, blocks = None, [], [], []

    def group():
        return names, sets, np.array(blocks) if key[1] != key[2] else None

    for batch in batches:
        cols = [batch[c].to_pylist() for c in ("family", "i", "j", "block", "cls", "shingles")]
        for family, i, j, block, cls, raw in zip(*cols, strict=True):
            if (family, i, j) != key:
                if names:
                    yield group()
                key, names, sets, blocks = (family, i, j), [], [], []
            names.append(cls)
            sets.append(tuple(np.frombuffer(raw, np.uint64).reshape(2, -1)))
            blocks.append(block)
    if names:
        yield group()


def _grouped(docs: DataFrame, num: int, den: int, width: int, k: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of docs (row, doc_id, text), and cls, rep, first and component of each class; ``first`` is its row of least doc_id, then least number."""
    found = write_table(signatures(docs, k, width), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")
    classes = found.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), first, F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = write_table(classes, "classes")
    families = components(candidate_edges(classes, k, num, den))
    links = write_table(family_links(docs, classes, families, k, width, num, den), "links")
    of = components(links)
    return found, classes.select("cls", "rep", "first").join(of.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))


def near_duplicates(docs: DataFrame, num: int = 4, den: int = 5, width: int = 5, k: int = 32) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; similarity of num / den or more links.

    kept: whether the row has its component's least doc_id, so of repeated rows with it all.
    """
    rows = write_table(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
    found, named = _grouped(rows, num, den, width, k)
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = named.join(least, "component").select("cls", "component_id")
    alone = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = found.select("doc_id", "n_shingles", "cls").join(by_class, "cls", "left").select("doc_id", "n_shingles", alone.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame, num: int = 4, den: int = 5, width: int = 5, k: int = 32, spare_unnamed: bool = True) -> DataFrame:
    """One row of each component, decided by each row's own text, and all rows without a set.

    The row of least doc_id stays, of several with it any one; a row without
    doc_id only where no row of the component has one.  With ``spare_unnamed``
    every row without doc_id stays besides.
    """
    rows = write_table(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "rows")  # row numbers that hold from here on
    found, named = _grouped(rows.select("row", "doc.doc_id", "doc.text"), num, den, width, k)
    stay = named.groupBy("component").agg(F.min("first").alias("first")).select("first.row")
    gone = found.where("cls is not null and doc_id is not null" if spare_unnamed else "cls is not null").select("row").join(stay, "row", "left_anti")
    return rows.join(gone, "row", "left_anti").select("doc.*")
