"""Language-model scores by context-tree weighting over bytes.

A text is modelled as its tokens: each lower-cased word's bytes and a space,
then a line feed for the end.  A byte is eight binary decisions.  For each
decision and each context of the last 0..depth bytes there are counts (n0, n1)
from the training texts; a context's Krichevsky-Trofimov estimate is
(n1 + 1/2) / (n0 + n1 + 1), and the probability P_e it gives to all its
training decisions has a closed form.  Weighting mixes all depths::

    P_w(s) = P_e(s)                                    at the full depth
    P_w(s) = 1/2 P_e(s) + 1/2 prod_c P_w(cs)           above it

so the next decision in context s has probability
w KT(s) + (1 - w) p(cs) with w = 1/2 P_e(s) / P_w(s), c being the byte before.
A context without training decisions adds nothing: its longest seen suffix
speaks for it.  Where no context was seen the probability is 1/2.

Nothing of the corpus is broadcast but the tables of contexts of 0 and 1 byte
(257 x 255 decisions at most).  Input partitions are cut into chunks of bounded
text where they are read.  A chunk sends its distinct (context, byte) codes and
words, in packed buckets, to where the corpus counts of each bucket are, gets
their probabilities back, and scores its own texts with them: only that moves
texts, once.  Buckets become more with the input.  Those of all chunks are
merged by groups of ``CHUNKS_A_TASK``, as often as it takes.  What is asked of a
bucket is split into parts of at least ``ASKED_AT_ONCE`` keys or the bucket's own
number; so the copies of a bucket that the parts need hold no more keys than are
asked for, what is moved grows with the input alone, and a hot context is spread.
No table has to fit one machine.

The base score is that of word unigrams with add-1/2 smoothing.  Words are told
apart by 64-bit hashes.

Defined results: null, empty and white-space texts consist of the end alone;
a null doc_id counts as the empty string for the split; repeated rows are
scored (and learnt from) each; without training rows every decision has
probability 1/2 and V is 0; an empty table gives no rows.  Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import narrow_batches, partitions_for, write_table
from siltstone.llm.words import LOWER, Slab, mix, slabs, span_hashes, words

SPACE, END = 0x20, 0x0A
BUCKETS, MOST_BUCKETS = 256, 1 << 16
CHUNKS_A_TASK = 64
CHUNK_BYTES = 64 << 20
ASKED_AT_ONCE = 4 << 20
#: Key of the end among words; no word has it, since no word is empty.
END_KEY = int(mix(np.zeros(1, np.uint64)).view(np.int64)[0])
_LOG2 = np.log(2.0)
_GAMMA_TABLE = 1 << 16


def _log_rising_half() -> np.ndarray:
    """ln(Gamma(n + 1/2) / Gamma(1/2)) for n below the table's size."""
    return np.concatenate(([0.0], np.cumsum(np.log(np.arange(_GAMMA_TABLE - 1) + 0.5))))


_HALF = _log_rising_half()
_FACT = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, _GAMMA_TABLE, dtype=float)))))


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def _log_half(n: np.ndarray) -> np.ndarray:
    big = n >= _GAMMA_TABLE
    return np.where(big, _stirling(np.maximum(n, 1) + 0.5) - 0.5 * np.log(np.pi), _HALF[np.minimum(n, _GAMMA_TABLE - 1)])


def _log_fact(n: np.ndarray) -> np.ndarray:
    big = n >= _GAMMA_TABLE
    return np.where(big, _stirling(np.maximum(n, 1) + 1.0), _FACT[np.minimum(n, _GAMMA_TABLE - 1)])


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the KT probability of any one sequence of n0 zeros and n1 ones."""
    return _log_half(n0) + _log_half(n1) - _log_fact(n0 + n1)


def byte_stream(slab: Slab, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The modelled bytes of a slab, each text after ``depth`` line feeds; where each text begins; where it ends."""
    w = words(slab)
    n = len(slab)
    at = w.first[1:] + np.arange(n)  # a text's end stands after its words
    starts = np.insert(w.starts, w.first[1:], 0)
    lengths = np.insert(w.ends - w.starts, w.first[1:], -1) + 1
    lengths[at] = depth
    out = np.concatenate(([0], np.cumsum(lengths)))
    source = np.repeat(starts - out[:-1], lengths) + np.arange(out[-1])
    data = np.append(LOWER[slab.data], np.zeros(depth + 1, np.uint8))
    stream = np.empty(depth + out[-1], np.uint8)
    stream[:depth] = END
    body = stream[depth:]
    body[:] = data[source]
    last = out[1:] - 1
    body[np.delete(last, at)] = SPACE
    ends = out[at]
    for j in range(depth):
        body[ends + j] = END
    begins = np.concatenate(([0], ends[:-1] + depth))
    return stream, begins + depth, ends + depth + 1


def codes(stream: np.ndarray, depth: int) -> np.ndarray:
    """For each byte after the first ``depth``: the bytes before it, latest first, then itself, as one number."""
    n = len(stream) - depth
    out = stream[depth:].astype(np.uint64)
    for j in range(1, depth + 1):
        out |= stream[depth - j : depth - j + n].astype(np.uint64) << np.uint64(8 * (depth + 1 - j))
    return out


class Level:
    """All contexts of one depth: decisions by key (context << 8 | node), with node = 1 followed by the bits so far."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> None:
        self.keys, self.n0, self.n1 = keys, n0, n1
        self.log_pe = log_kt(n0, n1)
        self.log_pw = self.log_pe
        self.share = np.ones(len(keys))

    def weigh(self, below: np.ndarray) -> None:
        """Take in the sum of the children's ln P_w."""
        self.log_pw = np.logaddexp(self.log_pe, below) - _LOG2
        self.share = np.exp(self.log_pe - _LOG2 - self.log_pw)


def decisions(context: np.ndarray, byte: np.ndarray, n: np.ndarray) -> Level:
    """The decisions made in ``n`` occurrences of bytes in contexts."""
    keys, zeros, ones = [], [], []
    order = np.lexsort((byte, context))
    context, byte, n = context[order], byte[order].astype(np.uint64), n[order]
    for j in range(8):
        key = context << np.uint64(8) | (np.uint64(1 << j) | byte >> np.uint64(8 - j))
        bit = (byte >> np.uint64(7 - j)) & np.uint64(1)
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        keys.append(key[new])
        ones.append(np.add.reduceat(n * bit.astype(np.int64), new) if len(new) else n)
        zeros.append(np.add.reduceat(n, new) - ones[-1] if len(new) else n)
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    return Level(key[order], np.concatenate(zeros)[order], np.concatenate(ones)[order])


def parents(keys: np.ndarray) -> np.ndarray:
    """Keys of the same decisions in contexts shorter by the earliest byte."""
    return keys >> np.uint64(16) << np.uint64(8) | keys & np.uint64(255)


def build(code: np.ndarray, n: np.ndarray, depth: int, top: int) -> list[Level]:
    """Levels ``top`` .. ``depth`` for distinct codes with counts, weighed from below."""
    levels: list[Level] = []
    context, byte = code >> np.uint64(8), code & np.uint64(255)
    for d in range(depth, top - 1, -1):
        level = decisions(context >> np.uint64(8 * (depth - d)), byte, n)
        if levels:
            level.weigh(np.bincount(np.searchsorted(level.keys, parents(levels[0].keys)), levels[0].log_pw, len(level.keys)))
        levels.insert(0, level)
    return levels


def log10_probability(code: np.ndarray, depth: int, levels: list[Level]) -> np.ndarray:
    """log10 of the model's probability of each code's byte in its context; the levels are of depths 0 .. depth."""
    total = np.zeros(len(code))
    context, byte = code >> np.uint64(8), code & np.uint64(255)
    for j in range(8):
        node = np.uint64(1 << j) | byte >> np.uint64(8 - j)
        one = (byte >> np.uint64(7 - j)) & np.uint64(1) == 1
        p = np.full(len(code), np.nan)
        for d in range(depth, -1, -1):
            level = levels[d]
            if not len(level.keys):
                continue
            key = context >> np.uint64(8 * (depth - d)) << np.uint64(8) | node
            at = np.minimum(np.searchsorted(level.keys, key), len(level.keys) - 1)
            seen = level.keys[at] == key
            own = (np.where(one, level.n1[at], level.n0[at]) + 0.5) / (level.n0[at] + level.n1[at] + 1)
            mixed = level.share[at] * own + (1 - level.share[at]) * p
            p = np.where(seen, np.where(np.isnan(p), own, mixed), p)
        total += np.log10(np.where(np.isnan(p), 0.5, p))
    return total


def top_levels(rows: list[tuple[int, int, int, float]]) -> list[Level]:
    """Levels 0 and 1 from rows (key of a level-1 decision, n0, n1, sum of its children's ln P_w)."""
    rows = sorted(rows)
    keys = np.array([r[0] for r in rows], np.uint64)
    first = Level(keys, np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))
    if len(keys):
        first.weigh(np.array([r[3] for r in rows], float))
    node, inverse = np.unique(parents(keys), return_inverse=True)
    root = Level(node, np.bincount(inverse, first.n0, len(node)).astype(np.int64), np.bincount(inverse, first.n1, len(node)).astype(np.int64))
    if len(node):
        root.weigh(np.bincount(inverse, first.log_pw, len(node)))
    return [root, first]


class Table:
    """Values by 64-bit key: one probe of a hash table, a binary search for what collides there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        bits = max(10, int(4 * max(1, len(keys)) - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.zeros(1 << bits, np.int32)
        self.slots[self._hash(self.keys)] = np.arange(len(keys), dtype=np.int32)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots[self._hash(keys)]
        missed = np.flatnonzero(self.keys[at] != keys)
        if len(missed):
            found = np.searchsorted(self.keys, keys[missed])
            at[missed] = found
            if found.max() >= len(self.keys) or (self.keys[found] != keys[missed]).any():
                raise KeyError("a chunk's table lacks one of its keys")
        return self.values[at]


def _scored(slab: Slab, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all modelled bytes of a slab, and where each text's begin (one more at the end)."""
    stream, begins, ends = byte_stream(slab, depth)
    all_codes = codes(stream, depth)
    keep = np.ones(len(all_codes), bool)
    for j in range(depth - 1):
        keep[ends - depth + j] = False
    first = np.concatenate(([0], np.cumsum(ends - begins)))
    return all_codes[keep], first


def _word_keys(slab: Slab) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens, the end of each text included, and where each text's begin."""
    w = words(slab)
    keys = np.insert(span_hashes(slab.data, w.starts, w.ends), w.first[1:], np.uint64(END_KEY % 2**64))
    return keys, w.first + np.arange(len(w.first))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _counted(keys: np.ndarray, first: np.ndarray, train: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys with their counts in training texts."""
    learnt = np.repeat(train, np.diff(first))
    seen, n = np.unique(keys[learnt], return_counts=True)
    other = np.unique(keys[~learnt])
    return [(seen, n), (other, np.zeros(len(other), np.int64))]


CODE, WORD, TEXT = 0, 1, 2


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers of one type as compressed planes of their bytes."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return x.dtype.str.encode() + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack_numbers(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:3].decode())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[3:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def pack_keys(x: np.ndarray) -> bytes:
    """Ascending keys, by their differences."""
    return pack_numbers(np.diff(x, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(data), dtype=np.uint64)


def bucket_of(kind: int, keys: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    """Codes with the same two latest bytes share a bucket, so it holds whole subtrees of contexts."""
    return (mix(keys >> np.uint64(8 * (depth - 1))) if kind == CODE else keys >> np.uint64(32)) % np.uint64(buckets)


def chunk_keys(chunk: int, out: dict[int, list], depth: int, buckets: int) -> Iterator[tuple]:
    """Rows (chunk, kind, bucket, asked, keys, n) of the distinct codes and words of a chunk with their counts in its training texts."""
    for kind, parts in out.items():
        keys, n = _merge(parts)
        bucket = bucket_of(kind, keys, depth, buckets)
        order = np.argsort(bucket, kind="stable")
        at = np.flatnonzero(np.diff(bucket[order], prepend=np.uint64(buckets)))
        for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(keys)], strict=True):
            yield chunk, kind, int(bucket[order[lo]]), hi - lo, pack_keys(keys[order[lo:hi]]), pack_numbers(n[order[lo:hi]])


def read_chunks(batches: Iterator[pa.RecordBatch], depth: int, buckets: int, limit: int) -> Iterator[pa.RecordBatch]:
    """From rows (doc_id, text, train): the same with their chunks, as kind ``TEXT``, and each chunk's keys; ``limit``: bytes of text a chunk."""
    chunk, size = TaskContext.get().partitionId() << 32, 0
    out: dict[int, list] = {CODE: [], WORD: []}

    def closed(like: pa.RecordBatch) -> pa.RecordBatch:
        rows = [pa.array(c, t) for c, t in zip(zip(*chunk_keys(chunk, out, depth, buckets), strict=True), KEYS_TYPES, strict=True)]
        return pa.RecordBatch.from_arrays([*rows, *(pa.nulls(len(rows[0]), c.type) for c in like.columns)], [*KEYS_NAMES, *like.schema.names])

    batch = None
    for batch in batches:
        train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for slab in slabs(batch.column(1)):
            if size and size + len(slab.data) > limit:
                yield closed(batch)
                chunk, size, out = chunk + 1, 0, {CODE: [], WORD: []}
            own = train[slab.first : slab.first + len(slab)]
            out[CODE] += _counted(*_scored(slab, depth), own)
            out[WORD] += _counted(*_word_keys(slab), own)
            for parts in out.values():
                if len(parts) > 16:
                    parts[:] = [_merge(parts)]
            size += len(slab.data) + len(slab)
            part = batch.slice(slab.first, len(slab))
            blank = [pa.array([x] * len(slab), t) for x, t in zip((chunk, TEXT, None, None, None, None), KEYS_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([*blank, *part.columns], [*KEYS_NAMES, *batch.schema.names])
    if size:
        yield closed(batch)


KEYS_NAMES = ["chunk", "kind", "bucket", "asked", "keys", "n"]
KEYS_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]


def merge_rows(table: pa.Table) -> pa.Table:
    """Rows of one bucket as one row of its distinct keys and their counts."""
    parts = [(unpack_keys(k), unpack_numbers(n)) for k, n in zip(table["keys"].to_pylist(), table["n"].to_pylist(), strict=True)]
    keys, n = _merge(parts)
    first = table.slice(0, 1)
    return pa.table({"kind": first["kind"], "bucket": first["bucket"], "part": first["part"], "held": [len(keys)], "learnt": [int((n > 0).sum())], "keys": pa.array([pack_keys(keys)], pa.binary()), "n": pa.array([pack_numbers(n)], pa.binary())})


def look_up(asked: pa.Table, known: pa.Table) -> pa.Table:
    """The values of the keys that chunks ask for, from the one row of their bucket."""
    if not asked.num_rows:
        return pa.table({"chunk": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "value": pa.array([], pa.binary())})
    keys, values = unpack_keys(known["keys"][0].as_py()), unpack_numbers(known["value"][0].as_py())
    found = [pack_numbers(values[np.searchsorted(keys, unpack_keys(k))]) for k in asked["keys"].to_pylist()]
    return pa.table({"chunk": asked["chunk"], "kind": asked["kind"], "keys": asked["keys"], "value": pa.array(found, pa.binary())})


def score_texts(texts: pa.RecordBatch, code: Table, word: Table, depth: int) -> pa.RecordBatch:
    """Scores of texts (doc_id, text, train) from the values of their chunk's codes and words."""
    n = texts.num_rows
    score, base, tokens, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for slab in slabs(texts.column(1)):
        at = slice(slab.first, slab.first + len(slab))
        keys, first = _scored(slab, depth)
        score[at] = np.add.reduceat(code.get(keys).astype(float), first[:-1])
        keys, first = _word_keys(slab)
        count = word.get(keys)
        base[at] = np.add.reduceat(np.log10(count + 0.5), first[:-1])
        known[at] = np.add.reduceat((count > 0).astype(np.int64), first[:-1])
        tokens[at] = np.diff(first)
    return pa.RecordBatch.from_arrays([texts.column(0), texts.column(2), *map(pa.array, (tokens, known, base, score))], ["doc_id", "train", "n_tokens", "n_known", "log_counts", "score"])


def score_chunks(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """From rows (chunk, kind, keys, value, doc_id, text, train) sorted by chunk, its values before its texts: scores."""
    now, tables, parts = None, None, {CODE: [], WORD: []}
    for batch in batches:
        chunk, text = batch.column(0).to_numpy(), batch.column(1).to_numpy() == TEXT
        edges = np.flatnonzero(np.concatenate(([True], (chunk[1:] != chunk[:-1]) | (text[1:] != text[:-1]), [True]))) if len(chunk) else []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            part = batch.slice(lo, hi - lo)
            if chunk[lo] != now:
                now, tables, parts = chunk[lo], None, {CODE: [], WORD: []}
            if not text[lo]:
                for kind, keys, value in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    parts[kind].append((unpack_keys(keys), unpack_numbers(value)))
                continue
            if tables is None:
                tables = [Table(*(np.concatenate(x) for x in zip(*parts.pop(kind), strict=True))) for kind in (CODE, WORD)]
            yield score_texts(part.select([4, 5, 6]), *tables, depth)


def _cogrouped(left: DataFrame, right: DataFrame, keys: list[str], least: int):
    """Both sides grouped by keys, in as many tasks as the session has or ``least``."""
    n = max(least, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return left.repartition(n, *keys).groupBy(*keys).cogroup(right.repartition(n, *keys).groupBy(*keys))


def score(docs: DataFrame, held_out: Column, depth: int = 5, chunk_bytes: int = 24 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of all texts.

    The model and the base learn from the rows for which ``held_out`` is false.
    ``depth``: bytes of context, 2 to 7.  ``chunk_bytes``: stored input bytes for
    which four buckets are made.
    """
    if not 2 <= depth <= 7:
        raise ValueError("depth must be 2 to 7")
    narrow_batches(docs.sparkSession)
    limit = CHUNK_BYTES
    buckets = min(MOST_BUCKETS, max(BUCKETS, 4 * partitions_for(docs, chunk_bytes)))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", (~F.coalesce(held_out, F.lit(False))).alias("train"))
    read = write_table(rows.mapInArrow(lambda b: read_chunks(b, depth, buckets, limit), f"chunk long, kind int, bucket int, asked long, keys binary, n binary, doc_id {id_type}, text string, train boolean"), "chunks")
    texts, found = read.where(f"kind = {TEXT}").select("chunk", "doc_id", "text", "train"), read.where(f"kind <> {TEXT}")
    chunks, parts_read = found.agg(F.count_distinct("chunk"), F.coalesce(F.max(F.shiftright("chunk", 32)) + 1, F.lit(0))).first()
    parts = max(1, -(-chunks // CHUNKS_A_TASK))
    merged = "kind int, bucket int, part int, held long, learnt long, keys binary, n binary"
    counts = found.select("kind", "bucket", F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int").alias("part"), "keys", "n")
    counts = counts.groupBy("kind", "bucket", "part").applyInArrow(merge_rows, merged)
    while parts > 1:
        parts = -(-parts // CHUNKS_A_TASK)
        counts = write_table(counts, "merged").withColumn("part", (F.col("part") % parts).cast("int")).groupBy("kind", "bucket", "part").applyInArrow(merge_rows, merged)
    counts = write_table(counts.select("kind", "bucket", "held", "learnt", "keys", "n"), "counts")

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
        for batch in batches:
            for row in batch.to_pylist():
                yield row, unpack_keys(row["keys"]), unpack_numbers(row["n"])

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, n in trees(batches):
            if (n > 0).any():
                level = build(key[n > 0], n[n > 0], depth, 2)[0]
                up, inverse = np.unique(parents(level.keys), return_inverse=True)
                sums = [np.bincount(inverse, x, len(up)) for x in (level.n0, level.n1, level.log_pw)]
                yield pa.RecordBatch.from_arrays([pa.array(up.view(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2])], ["key", "n0", "n1", "below"])

    summed = counts.where(f"kind = {CODE}").mapInArrow(tops, "key long, n0 long, n1 long, below double").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below"))
    upper = top_levels([tuple(r) for r in summed.collect()])  # 256 x 255 rows at most

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, key, n in trees(batches):
            if row["kind"] == CODE:
                levels = upper + build(key[n > 0], n[n > 0], depth, 2)
                value = np.concatenate([log10_probability(key[at : at + (1 << 16)], depth, levels) for at in range(0, len(key), 1 << 16)]).astype(np.float32)
            else:
                value = n
            yield pa.RecordBatch.from_arrays([pa.array([row["kind"]], pa.int32()), pa.array([row["bucket"]], pa.int32()), pa.array([row["keys"]], pa.binary()), pa.array([pack_numbers(value)], pa.binary())], ["kind", "bucket", "keys", "value"])

    values = counts.repartition("kind", "bucket").mapInArrow(predict, "kind int, bucket int, keys binary, value binary")
    asked = found.groupBy("kind", "bucket").agg(F.sum("asked").alias("asked")).join(counts.select("kind", "bucket", "held"), ["kind", "bucket"])
    split = write_table(asked.select("kind", "bucket", F.ceil(F.col("asked") / F.greatest("held", F.lit(ASKED_AT_ONCE))).cast("int").alias("parts"), "asked"), "split")  # a row for each bucket, 2 * MOST_BUCKETS at most
    steps = split.agg(F.coalesce(F.sum("asked"), F.lit(0))).first()[0] // ASKED_AT_ONCE
    values = values.join(F.broadcast(split.drop("asked")), ["kind", "bucket"]).select("kind", "bucket", "keys", "value", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asking = found.select("chunk", "kind", "bucket", "keys").join(F.broadcast(split.drop("asked")), ["kind", "bucket"])
    asking = asking.select("chunk", "kind", "bucket", F.pmod(F.xxhash64("chunk"), F.col("parts")).cast("int").alias("part"), "keys")
    returned = _cogrouped(asking, values, ["kind", "bucket", "part"], steps).applyInArrow(look_up, "chunk long, kind int, keys binary, value binary")
    schema = f"doc_id {id_type}, train boolean, n_tokens long, n_known long, log_counts double, score double"
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", id_type), ("text", "string"), ("train", "boolean"))]
    work = returned.select("chunk", "kind", "keys", "value", *blank)
    work = work.unionByName(texts.select("chunk", F.lit(TEXT).alias("kind"), *[F.lit(None).cast("binary").alias(c) for c in ("keys", "value")], "doc_id", "text", "train"))
    # Chunks of one input partition have numbers that follow one another; this deals them over the tasks evenly.
    place = F.shiftright("chunk", 32) + F.col("chunk").bitwiseAND(F.lit((1 << 32) - 1)) * F.lit(parts_read)
    tasks = max(chunks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = work.repartitionById(tasks, F.pmod(place, F.lit(tasks)).cast("int")).sortWithinPartitions("chunk", "kind")
    scored = dealt.mapInArrow(lambda b: score_chunks(b, depth), schema)
    scored = write_table(scored, "scores")
    total = scored.where("train").agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    distinct = counts.where(f"kind = {WORD}").agg(F.coalesce(F.sum("learnt"), F.lit(0))).first()[0]
    norm = float(np.log10(total + 0.5 * (distinct + 1)))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("log_counts") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score")
