"""Benchmark decontamination by SimHash of item-sized windows.

An item of n words is looked for in every window of n words of every text (a
text of fewer words is one window).  Windows and items are multisets of
``width``-word shingles, a shingle weighing as many bytes as its words have.
Similarity is weighted Jaccard: the sum of the lesser weights over the sum of
the greater.

Fingerprints have 64 bits, cut into ``BLOCKS`` blocks.  Every item is listed
under each value within ``FLIPS`` bits of each of its blocks.  If two
fingerprints differ in at most BLOCKS * (FLIPS + 1) - 1 = 23 bits, some block
differs in at most FLIPS, so one look at each block's list finds every item
within that radius.  Items found are confirmed by exact weighted similarity.  (At similarity 0.8 about 10 of 64 bits differ, with
standard deviation 3.)  So wide a radius takes in a large share of the items;
what keeps windows few is the next step, which comes before.

Before fingerprints are made, windows are passed over in which the shingles
that any item has weigh less than the threshold's share of the window.  This
loses nothing: their similarity with any item is below the threshold.

Items are taken by passes of ``PASS_BYTES`` of text, so what each pass broadcasts
is bounded; texts are never shuffled.  Where contaminated documents are dropped,
each row is judged by its own text, with or without a doc_id.  Shingles are told
apart by 64-bit hashes.

Defined results: null and empty texts and items match nothing; an item of fewer
words than a shingle is one shingle and matches equal runs of words only;
repeated rows and repeated item_ids are matched each (equal pairs are merged
with the best similarity); of equally similar windows the first is given; empty
tables give no rows.  Only ``doc_id``, ``text``, ``item_id`` and ``text`` of
the benchmark are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import narrow_batches
from siltstone.llm.words import Slab, mix, shingle_hashes, short_text_hashes, slabs, span_hashes, words

BLOCKS, FLIPS = 6, 3
RADIUS = BLOCKS * (FLIPS + 1) - 1
PASS_BYTES, ITEM_BYTES = 16 << 20, 1024  # an item counts with its text and what its lists take
#: Items looked at at once, in the lists of all windows at hand.
LISTED_AT_ONCE = 1 << 21
_WIDTHS = [11, 11, 11, 11, 10, 10]
_SHIFTS = [sum(_WIDTHS[:i]) for i in range(BLOCKS)]
_FLIPPED = [np.array([sum(1 << b for b in c) for r in range(FLIPS + 1) for c in combinations(range(bits), r)], np.int64) for bits in _WIDTHS]


def simhash(signs_total: np.ndarray) -> np.ndarray:
    """Fingerprints from rows of 64 sums of signed weights."""
    bits = (signs_total > 0).astype(np.uint64)
    return (bits << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)


def signed(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of remixed shingle hashes."""
    h = mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    return ((h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int64) * 2 - 1


class Shingled:
    """Shingle hashes and weights of texts of a slab, with prefix sums of the weights."""

    def __init__(self, slab: Slab, width: int) -> None:
        w = words(slab)
        self.word_hashes = span_hashes(slab.data, w.starts, w.ends)
        self.word_first = w.first
        self.hashes, self.first = shingle_hashes(self.word_hashes, w.first, width)
        size = np.concatenate(([0], np.cumsum(w.ends - w.starts)))
        count = np.diff(w.first)
        owner = np.repeat(np.arange(len(count)), np.diff(self.first))
        at = w.first[:-1][owner] + np.arange(len(owner)) - self.first[:-1][owner]
        self.weights = size[at + np.minimum(width, count[owner])] - size[at]
        self.words = count


class Index:
    """Items by the near values of their fingerprints' blocks."""

    def __init__(self, item_ids: list, texts: list[str], width: int) -> None:
        self.width = width
        found = Shingled(next(slabs(pa.array(texts, pa.large_string()), 1 << 62)), width) if texts else None
        keep = [i for i in range(len(texts)) if found.words[i]]
        self.item_ids = [item_ids[i] for i in keep]
        self.sizes = np.array([found.words[i] for i in keep], np.int64)
        self.sets = []
        prints = np.zeros(len(keep), np.uint64)
        for row, i in enumerate(keep):
            part = slice(found.first[i], found.first[i + 1])
            h, w = found.hashes[part], found.weights[part]
            prints[row] = simhash((signed(h) * w[:, None]).sum(0)[None])[0]
            self.sets.append(_weighed(h, w))
        self.prints = prints
        self.shingles = np.unique(np.concatenate([s[0] for s in self.sets])) if keep else np.zeros(0, np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.shingles >> np.uint64(44)] = True
        self.lists = []
        for shift, bits, flips in zip(_SHIFTS, _WIDTHS, _FLIPPED, strict=True):
            value = (prints >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1)
            near = (value[:, None] ^ flips).reshape(-1)
            order = np.argsort(near, kind="stable")
            self.lists.append((np.searchsorted(near[order], np.arange((1 << bits) + 1)), (order // len(flips)).astype(np.int32)))
        #: Windows whose lists hold LISTED_AT_ONCE items at most.
        self.at_once = max(1, LISTED_AT_ONCE // max(1, len(keep)))
        #: Sizes to slide windows of; shorter items are matched as one shingle of their own length.
        self.lengths = np.unique(self.sizes)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Whether any item has the shingle."""
        out = self.maybe[hashes >> np.uint64(44)]
        at = np.flatnonzero(out)
        if len(at):
            pos = np.minimum(np.searchsorted(self.shingles, hashes[at]), len(self.shingles) - 1)
            out[at] = self.shingles[pos] == hashes[at]
        return out

    def within_radius(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (fingerprint, item) pairs that differ in at most RADIUS bits."""
        pairs = []
        for (first, listed), shift, bits in zip(self.lists, _SHIFTS, _WIDTHS, strict=True):
            value = (prints >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1)
            n = first[value + 1] - first[value]
            owner = np.repeat(np.arange(len(prints)), n)
            item = listed[np.repeat(first[value] - (np.cumsum(n) - n), n) + np.arange(len(owner))].astype(np.int64)
            near = np.bitwise_count(prints[owner] ^ self.prints[item]) <= RADIUS
            pairs.append(owner[near] * len(self.prints) + item[near])
        both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        return both // max(1, len(self.prints)), both % max(1, len(self.prints))


def _weighed(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, where, count = np.unique(h, return_index=True, return_counts=True)
    return keys, w[where] * count


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of sorted keys with weights."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(x[1][i], y[1][j]).sum())
    union = int(x[1].sum() + y[1].sum()) - least
    return least / union if union else 0.0


def text_matches(index: Index, h: np.ndarray, w: np.ndarray, hit: np.ndarray, n_words: int, threshold: float) -> dict[int, tuple[float, int, int]]:
    """Items found in one text: (similarity, first word, words) of the best window.

    h, w, hit: hash, weight and whether any item has it, of each shingle.
    """
    width = index.width
    total, hits = np.concatenate(([0], np.cumsum(w))), np.concatenate(([0], np.cumsum(w * hit)))
    begins, ends, sizes = [], [], []
    for n in index.lengths.tolist():
        if n < width and n != n_words or n >= width > n_words:
            continue  # an item that short is looked for as a run of words; one that long is no match for such a text
        if n < width:
            begins.append(np.array([0]))
            ends.append(np.array([1]))
            sizes.append(np.array([n]))
            continue
        m = min(n, n_words) - width + 1
        begin = np.arange(len(h) - m + 1)
        ok = hits[begin + m] - hits[begin] >= threshold * (total[begin + m] - total[begin])
        begin = begin[ok]
        begins.append(begin)
        ends.append(begin + m)
        sizes.append(np.full(len(begin), n))
    out: dict[int, tuple[float, int, int]] = {}
    begin, end, size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begins, ends, sizes))
    if not len(begin):
        return out
    lo, hi = int(begin.min()), int(end.max())
    sums = np.concatenate((np.zeros((1, 64), np.int64), np.cumsum(signed(h[lo:hi]) * w[lo:hi, None], axis=0)))
    for at in range(0, len(begin), index.at_once):
        b, e, s = (x[at : at + index.at_once] for x in (begin, end, size))
        owner, item = index.within_radius(simhash(sums[e - lo] - sums[b - lo]))
        fits = index.sizes[item] == s[owner]
        for k, i in zip(owner[fits].tolist(), item[fits].tolist(), strict=True):
            sim = similarity(_weighed(h[b[k] : e[k]], w[b[k] : e[k]]), index.sets[i])
            if sim >= threshold and (i not in out or (-sim, b[k]) < (-out[i][0], out[i][1])):
                out[i] = (sim, int(b[k]), int(min(index.sizes[i], n_words)))
    return out


def _short_matches(index: Index, found: Shingled) -> Iterator[tuple[int, int, tuple[float, int, int]]]:
    """Runs of words equal to an item of fewer words than a shingle, in texts that are longer than the item."""
    for n in (int(x) for x in index.lengths if x < index.width):
        items = np.flatnonzero(index.sizes == n)
        keys = np.array([index.sets[i][0][0] for i in items], np.uint64)
        order = np.argsort(keys, kind="stable")
        runs = short_text_hashes(found.word_hashes, n)
        lo, hi = (np.searchsorted(keys[order], runs, side) for side in ("left", "right"))
        at = np.flatnonzero(hi > lo)
        text = np.searchsorted(found.word_first, at, "right") - 1
        whole = (at + n <= found.word_first[text + 1]) & (found.words[text] > n)  # within one text, which is longer
        seen = set()
        for p, i in zip(at[whole].tolist(), text[whole].tolist(), strict=True):
            for item in items[order[lo[p] : hi[p]]].tolist():
                if (i, item) not in seen:
                    seen.add((i, item))
                    yield i, item, (1.0, p - int(found.word_first[i]), n)


@functools.lru_cache(maxsize=2)
def _index(item_ids: tuple, texts: tuple, width: int) -> Index:
    return Index(list(item_ids), list(texts), width)


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity of the best window for each document and item found in it."""
    spark = docs.sparkSession
    narrow_batches(spark)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, start_word long, n_words long, similarity double"
    found = spark.createDataFrame([], schema)
    for ids, texts in _passes(benchmark):
        found = found.unionByName(docs.select("doc_id", "text").mapInArrow(_finder(ids, texts, threshold, width), schema))
    best = F.max_by(F.struct("start_word", "n_words", "similarity"), F.struct("similarity", -F.col("start_word")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("m")).select("doc_id", "item_id", "m.start_word", "m.n_words", "m.similarity")


def _found(index: Index, column: pa.Array, threshold: float) -> Iterator[tuple[int, int, tuple[float, int, int]]]:
    """(row, item, (similarity, first word, words)) of every item found in the texts of a column."""
    for slab in slabs(column):
        found = Shingled(slab, index.width)
        hit = index.has(found.hashes)
        counts = np.concatenate(([0], np.cumsum(hit)))
        for i in np.flatnonzero(np.diff(counts[found.first])).tolist():
            part = slice(found.first[i], found.first[i + 1])
            for item, match in text_matches(index, found.hashes[part], found.weights[part], hit[part], int(found.words[i]), threshold).items():
                yield slab.first + i, item, match
        for i, item, match in _short_matches(index, found):
            yield slab.first + i, item, match


def _finder(item_ids: tuple, texts: tuple, threshold: float, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(item_ids, texts, width)
        for batch in batches:
            rows = list(_found(index, batch.column(1), threshold))
            if rows:
                numbers = [pa.array([m[j] for _, _, m in rows], kind) for j, kind in ((1, pa.int64()), (2, pa.int64()), (0, pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _, _ in rows])), pa.array([index.item_ids[k] for _, k, _ in rows]), *numbers], ["doc_id", "item_id", "start_word", "n_words", "similarity"])

    return run


def _passes(benchmark: DataFrame) -> Iterator[tuple[tuple, tuple]]:
    """Ids and texts of about PASS_BYTES of items at a time."""
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text").cast("long") + ITEM_BYTES)).first()[0] or 0
    passes = -(-size // PASS_BYTES)
    for at in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == at).collect()
        yield tuple(r["item_id"] for r in rows), tuple(r["text"] for r in rows)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """The rows in whose text no benchmark item is found; texts are filtered where they are read, so nothing is shuffled."""
    narrow_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def clean(ids: tuple, texts: tuple):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(ids, texts, width)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[i for i, _, _ in _found(index, batch.column(at), threshold)]] = False
                yield batch.filter(pa.array(keep))

        return run

    for ids, texts in _passes(benchmark):
        docs = docs.mapInArrow(clean(ids, texts), docs.schema)
    return docs
