"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs and digit substitutions to the letters
they stand for, drops invisible characters, and makes punctuation space.  The
lexicon holds beginnings of words with weights: log-odds of toxic against other
texts.  Exception phrases (a word, a space and a lexicon entry) cancel the
entry's match.  A text's weight is normalised by its length, and a logistic
curve makes it a probability.

The lexicon, the exceptions and the curve are learnt from a bounded sample of
labelled texts, which is read once: occurrences of each word beginning of 3 to
12 letters are counted on executors (longer words speak by their first 12); those far commoner in toxic texts (likelihood ratio over ``MIN_G2``) are kept,
of entries that begin one another the more telling one.

Defined results: null and empty texts have weight 0, and the curve's score for
that; without labels of both values every score is the share of toxic labels
(0.5 without any); repeated rows are scored each; an empty table gives no rows.
Only ``doc_id`` and ``text``, and of labels ``doc_id`` and the label, are read.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.labels import fit_logistic, labelled, sigmoid
from siltstone.llm.shared import narrow_batches, write_table
from siltstone.llm.words import as_text

#: Labelled texts to learn from.
SAMPLE = 20_000
PREFIXES = range(3, 13)
MIN_G2, MIN_TEXTS = 30.0, 3
#: The score from which the pipeline drops a text, the one from which op5_toxicity calls it toxic.
TOXIC = 0.3

_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Look-alikes of Latin letters in the Cyrillic and Greek blocks.
_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԁ": "d", "ɡ": "g", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
_INVISIBLE = "­​‌‍⁠﻿"
_WIDE = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}


def _ascii_table() -> bytes:
    table = bytearray(range(256))
    for i in range(128):
        c = chr(i)
        table[i] = ord(_DIGITS.get(c, c.lower() if c.isalnum() else " "))
    return bytes(table)


_ASCII = _ascii_table()
_OTHER = {ord(k): v for k, v in _LOOKALIKES.items()} | {ord(c): None for c in _INVISIBLE} | {ord(k): (_DIGITS.get(v, v.lower() if v.isalnum() else " ")) for k, v in _WIDE.items()} | {c: " " for c in [*range(0x2010, 0x2060), 0xA0, 0xA1, 0xAB, 0xBB, 0xBF, 0x3000] if chr(c) not in _INVISIBLE}
_SPECIAL = re.compile("[" + re.escape("".join(map(chr, _OTHER))) + "]")


def fold(text: str) -> str:
    """Folded text with a space at each end."""
    text = text.lower()
    if text.isascii():
        return " " + text.encode().translate(_ASCII).decode() + " "
    if _SPECIAL.search(text):
        text = text.translate(_OTHER)
    return " " + text.encode().translate(_ASCII).decode() + " "


@dataclass
class Lexicon:
    """Weights of word beginnings, exception phrases, and the curve on the features of a text."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: list[float] = field(default_factory=list)
    prior: float = 0.5

    def key(self) -> tuple:
        return tuple(sorted(self.weights.items())), tuple(self.exceptions)


@functools.lru_cache(maxsize=2)
def automaton(weights: tuple, exceptions: tuple):
    """Matches " beginning" as (length, weight) and " word beginning" as (length, None)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for term, weight in weights:
        a.add_word(" " + term, (len(term) + 1, weight))
    for phrase in exceptions:
        a.add_word(" " + phrase, (len(phrase) + 1, None))
    a.make_automaton()
    return a


def hits(folded: str, matcher) -> list[tuple[int, float]]:
    """Where lexicon entries begin, with their weights, but for those that end as an exception phrase does."""
    found, spared = [], set()
    for end, (length, weight) in matcher.iter(folded) if len(matcher) else ():
        if weight is None:
            spared.add(end)
        else:
            found.append((end, length, weight))
    return [(end - length + 1, weight) for end, length, weight in found if end not in spared]


def features(weight: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Weight in all, per thousand characters, per square root of length; and the length."""
    thousands = (length + 200) / 1000
    return np.column_stack((np.log1p(weight), np.log1p(weight / thousands), weight / np.sqrt(1 + 10 * thousands), np.log(thousands), np.minimum(count, 3)))


def _words_of(folded: str) -> set[str]:
    return set(folded.split())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, toxic texts and other texts that have it, in parts of bounded size."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> Iterator[pa.RecordBatch]:
        for label in (0, 1):
            if seen[label]:
                n = np.fromiter(seen[label].values(), np.int64, len(seen[label]))
                zero = np.zeros(len(n), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(list(seen[label])), pa.array(n if label else zero), pa.array(zero if label else n)], ["word", "pos", "neg"])
                seen[label].clear()

    for batch in batches:
        for text, label in zip(as_text(batch["text"]).to_pylist(), batch["label"].to_pylist(), strict=True):
            seen[label].update(_words_of(fold(text)))
        if len(seen[0]) + len(seen[1]) > 400_000:
            yield from out()
    yield from out()


def choose_terms(rows: list[tuple[str, int, int]], pos: int, neg: int) -> dict[str, float]:
    """Weights of the most telling beginnings, none of which begins another.

    rows: (beginning, its occurrences in toxic texts, in others); pos, neg: all occurrences of words.
    """
    scored = []
    for term, a, b in rows:
        g2 = likelihood_ratio(a, b, pos, neg)
        scored.append((-g2, -len(term), term, math.log((a + 0.5) / (pos + 1)) - math.log((b + 0.5) / (neg + 1))))
    chosen: dict[str, float] = {}
    beginnings: set[str] = set()
    for _, _, term, weight in sorted(scored):
        if term in beginnings or any(term[:i] in chosen for i in range(1, len(term))):
            continue
        chosen[term] = weight
        beginnings.update(term[:i] for i in range(1, len(term)))
    return chosen


def likelihood_ratio(a: int, b: int, pos: int, neg: int) -> float:
    """G squared of a occurrences among pos and b among neg."""
    share = (a + b) / (pos + neg)
    return 2 * sum(x * math.log(x / (n * share)) for x, n in ((a, pos), (b, neg)) if x)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", train: Column | None = None, sample: int = SAMPLE, exceptions: list[str] | None = None) -> Lexicon:
    """A lexicon and its curve from about ``sample`` labelled texts; ``exceptions`` come on top of learnt ones."""
    spark = docs.sparkSession
    narrow_batches(spark)
    texts = labelled(docs, labels, label, train, sample)
    words = write_table(texts.mapInArrow(_count_words, "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "words")
    total = words.agg(F.coalesce(F.sum("pos"), F.lit(0)), F.coalesce(F.sum("neg"), F.lit(0))).first()
    if not total[0] or not total[1]:
        known = texts.agg(F.avg("label")).first()[0]
        return Lexicon({}, prior=0.5 if known is None else float(known))
    pos, neg = int(total[0]), int(total[1])
    begun = words.select(F.explode(F.array_distinct(F.array(*[F.substring("word", 1, n) for n in PREFIXES]))).alias("term"), "pos", "neg").where(F.length("term") >= PREFIXES[0])
    begun = begun.groupBy("term").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b")).where(f"a >= {MIN_TEXTS} and a * {neg}.0 > 3.0 * b * {pos}.0")
    share = (F.col("a") + F.col("b")) / (pos + neg)
    g2 = 2 * (F.col("a") * F.log(F.col("a") / (pos * share)) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (neg * share))).otherwise(0))
    rows = begun.withColumn("g2", g2).where(F.col("g2") >= MIN_G2).collect()  # bounded by the sample, as are the phrases
    lexicon = Lexicon(choose_terms([(r["term"], r["a"], r["b"]) for r in rows], pos, neg), sorted({fold(x).strip() for x in exceptions or []}))
    lexicon.exceptions = sorted({*lexicon.exceptions, *_spared(texts, lexicon)})
    raw = texts.select(F.lit(0).alias("doc_id"), "text", "label").mapInArrow(_scorer(lexicon, "label"), "doc_id int, label int, weight double, count long, length long").select("label", "weight", "count", "length").toPandas()  # the sample's few numbers
    y = raw["label"].to_numpy(float)
    lexicon.prior = float(y.mean())
    lexicon.curve = fit_logistic(features(raw["weight"].to_numpy(), raw["count"].to_numpy(), raw["length"].to_numpy()), y).tolist()
    return lexicon


def _spared(texts: DataFrame, lexicon: Lexicon) -> list[str]:
    """Phrases of the word before and the entry that at least MIN_TEXTS other texts have, and no toxic one."""
    key = lexicon.key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = automaton(*key)
        terms = dict(key[0])
        for batch in batches:
            rows = []
            for text, label in zip(as_text(batch["text"]).to_pylist(), batch["label"].to_pylist(), strict=True):
                folded = fold(text)
                phrases = set()
                for at, _ in hits(folded, matcher):
                    before = folded[:at].rsplit(None, 1)[-1:] or [""]
                    term = next(folded[at + 1 : at + 1 + n] for n in range(1, 40) if folded[at + 1 : at + 1 + n] in terms)
                    if before[0]:
                        phrases.add(f"{before[0]} {term}")
                rows += [(p, label) for p in phrases]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32())], ["phrase", "label"])

    found = texts.mapInArrow(run, "phrase string, label int").groupBy("phrase").agg(F.sum("label").alias("a"), F.count("*").alias("n"))
    rows = found.where(f"a = 0 and n >= {MIN_TEXTS}").collect()
    return [r["phrase"] for r in rows]


def _scorer(lexicon: Lexicon, extra: str | None = None):
    key = lexicon.key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = automaton(*key)
        for batch in batches:
            weight, count, length = [], [], []
            for text in as_text(batch["text"]).to_pylist():
                folded = fold(text)
                found = hits(folded, matcher)
                weight.append(sum(max(0.0, w) for _, w in found))
                count.append(len(found))
                length.append(len(folded) - 2)
            more = [batch[extra]] if extra else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *more, pa.array(weight, pa.float64()), pa.array(count, pa.int64()), pa.array(length, pa.int64())], ["doc_id", *([extra] if extra else []), "weight", "count", "length"])

    return run


def scores(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, weight and number of matches, length in characters, and score of every row."""
    narrow_batches(docs.sparkSession)
    inner = _scorer(lexicon)
    curve, prior = np.array(lexicon.curve), lexicon.prior

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in inner(batches):
            weight, count, length = (batch[c].to_numpy() for c in ("weight", "count", "length"))
            score = sigmoid(np.column_stack((features(weight, count, length), np.ones(len(weight)))) @ curve) if len(curve) else np.full(len(weight), prior)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, weight double, count long, length long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = TOXIC) -> DataFrame:
    """The documents with a score under ``threshold``, learnt from all labels."""
    narrow_batches(docs.sparkSession)
    lexicon = learn(docs, labels)
    key, curve, prior = lexicon.key(), np.array(lexicon.curve), lexicon.prior
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = automaton(*key)
        for batch in batches:
            folded = [fold(t) for t in as_text(batch.column(at)).to_pylist()]
            found = [hits(f, matcher) for f in folded]
            weight = np.array([sum(max(0.0, w) for _, w in h) for h in found])
            x = features(weight, np.array([len(h) for h in found]), np.array([len(f) - 2 for f in folded]))
            score = sigmoid(np.column_stack((x, np.ones(len(x)))) @ curve) if len(curve) else np.full(len(x), prior)
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
