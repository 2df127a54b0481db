"""Quality by a sparse ensemble of rules over text statistics.

Statistics of a text (``STATS``) are counted in one pass.  Boosted trees of
small depth are grown on a bounded sample of labelled texts; every path from a
root to a node is a rule, a conjunction of comparisons of statistics.  Lasso
logistic regression weighs the rules and leaves few.  The rules that stay are
compiled into a Spark column expression.

Defined results: null and empty texts have statistics 0 and the ensemble's
score for that; without labels of both values every score is the share of good
labels (0.5 without any); repeated rows are scored each; an empty table gives
no rows.  Only ``doc_id`` and ``text``, and of labels ``doc_id`` and the label,
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.labels import labelled, sigmoid
from siltstone.llm.shared import narrow_batches
from siltstone.llm.words import Slab, slabs, span_hashes, words

#: Labelled texts to learn from.
SAMPLE = 20_000
TREES, DEPTH, BINS = 24, 3, 48
LASSO = 2e-3

_CLASSES = {
    "upper": [*range(65, 91)],
    "letters": [*range(65, 91), *range(97, 123), *range(0xC3, 0x100)],
    "digits": [*range(48, 58)],
    "symbols": [ord(c) for c in "#$%&*+<=>@\\^_`{|}~/"],
    "stops": [ord(c) for c in ".,;:"],
    "shouts": [ord(c) for c in "!?"],
    "bars": [ord("|")],
    "lines": [ord("\n")],
}
_TABLES = {name: np.isin(np.arange(256), codes) for name, codes in _CLASSES.items()}
STATS = [*(f"{name}_share" for name in _CLASSES), "log_bytes", "word_length", "distinct_words", "distinct_pairs", "repeats", "top_word", "short_words", "long_words", "odd_ends", "words_per_line", "distinct_lines"]


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
    return (total[first[1:]] - total[first[:-1]]).astype(float)


def _distinct(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text: its number of distinct keys, and the count of the commonest."""
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])))) if len(k) else np.zeros(0, np.int64)
    count, top = np.zeros(len(n)), np.zeros(len(n))
    if len(new):
        np.add.at(count, o[new], 1)
        np.maximum.at(top, o[new], np.diff(np.append(new, len(k))))
    return count, top


def slab_statistics(slab: Slab) -> np.ndarray:
    """One row of STATS for each text of a slab."""
    data, bounds = slab.data, slab.bounds
    size = np.diff(bounds).astype(float)
    some = np.maximum(size, 1)
    w = words(slab)
    n = np.diff(w.first).astype(float)
    per = np.maximum(n, 1)
    keys = span_hashes(data, w.starts, w.ends)
    length = w.ends - w.starts
    rows = [_sums(table[data], bounds) / some for table in _TABLES.values()]
    distinct, top = _distinct(keys, w.first)
    inside = np.ones(max(0, len(keys) - 1), bool)
    inside[w.first[1:-1][(w.first[1:-1] > 0) & (w.first[1:-1] < len(keys))] - 1] = False
    same = np.append((keys[1:] == keys[:-1]) & inside, [False] * min(1, len(keys)))
    pair_first = np.concatenate(([0], np.cumsum(np.maximum(np.diff(w.first) - 1, 0))))
    pairs = (keys[:-1] * np.uint64(0x9FB21C651E98DF25) + keys[1:])[inside] if len(keys) else keys
    distinct_pairs, _ = _distinct(pairs, pair_first)
    line_at = np.flatnonzero(_TABLES["lines"][data])
    starts = np.unique(np.concatenate((bounds[:-1][size > 0], line_at + 1)))
    starts = starts[starts < len(data)]
    line_first = np.searchsorted(starts, bounds)
    lines, _ = _distinct(span_hashes(data, starts, np.append(starts[1:], len(data))[: len(starts)]), line_first)
    n_lines = np.maximum(np.diff(line_first), 1)
    ends = data[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
    odd = _TABLES["symbols"][ends] | _TABLES["shouts"][ends]
    rows += [np.log1p(size), _sums(length, w.first) / per, distinct / per, distinct_pairs / np.maximum(per - 1, 1), _sums(same, w.first) / per, top / per, _sums(length <= 3, w.first) / per, _sums(length > 14, w.first) / per, _sums(odd, w.first) / per, n / n_lines, lines / n_lines]
    return np.column_stack(rows)


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of documents and a column for each of STATS, named ``stat_`` and its name."""
    return _counted(docs, keep).select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)], *[f"stat_{s}" for s in STATS])


def _counted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The statistics beside the ``keep`` columns as kept_0, kept_1 and so on, so that no name clashes."""
    names = [f"stat_{s}" for s in STATS]
    sent = keep if "text" in keep else [*keep, "text"]
    at = sent.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch.column(at)):
                kept = batch.slice(slab.first, len(slab)).columns[: len(keep)]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c) for c in slab_statistics(slab).T)], [*(f"kept_{i}" for i in range(len(keep))), *names])

    narrow_batches(docs.sparkSession)
    schema = ", ".join([*(f"kept_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), *(f"{n} double" for n in names)])
    return docs.select(*sent).mapInArrow(run, schema)


Rule = tuple[tuple[int, bool, float], ...]  #: (statistic, whether it must be over, bound), all of which hold


@dataclass
class Ensemble:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def column(self) -> Column:
        """The score as a Spark expression over the columns of ``statistics``."""

        def holds(rule: Rule) -> Column:
            return reduce(lambda a, b: a & b, [(F.col(f"stat_{STATS[i]}") > bound) if over else (F.col(f"stat_{STATS[i]}") <= bound) for i, over, bound in rule])

        z = reduce(lambda a, b: a + b, [F.when(holds(r), F.lit(w)).otherwise(0.0) for r, w in zip(self.rules, self.weights, strict=True)], F.lit(self.intercept))
        return 1 / (1 + F.exp(-z))


def rule_matrix(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    out = np.ones((len(x), len(rules)), bool)
    for k, rule in enumerate(rules):
        for i, over, bound in rule:
            out[:, k] &= x[:, i] > bound if over else x[:, i] <= bound
    return out.astype(float)


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> list[Rule]:
    """Rules of gradient-boosted trees on halves of the rows."""
    rng = np.random.default_rng(seed)
    bounds = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(b, c, "left") for b, c in zip(bounds, x.T, strict=True)])
    z = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = sigmoid(z)
        gradient, curvature = y - p, np.maximum(p * (1 - p), 1e-4)
        rows = rng.permutation(len(y))[: max(1, len(y) // 2)] if len(y) > 200 else np.arange(len(y))
        for rule, value, member in _tree(binned, bounds, gradient, curvature, rows, np.arange(len(y)), (), depth):
            rules[rule] = None
            if member is not None:
                z[member] += 0.4 * value
    return list(rules)


def _tree(binned: np.ndarray, bounds: list, gradient: np.ndarray, curvature: np.ndarray, rows: np.ndarray, members: np.ndarray, path: Rule, depth: int) -> Iterator[tuple[Rule, float, np.ndarray | None]]:
    """(rule, value, rows) of each node below the root; rows only of leaves."""
    g, h = gradient[rows], curvature[rows]
    best, least = None, max(5, len(gradient) // 500)
    if depth and len(rows) >= 2 * least:
        for i, b in enumerate(bounds):
            if not len(b):
                continue
            k = binned[rows, i]
            gs, hs, n = (np.cumsum(np.bincount(k, v, len(b) + 1))[:-1] for v in (g, h, None))
            gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1)
            gain[(n < least) | (len(rows) - n < least)] = -1
            j = int(np.argmax(gain))
            if gain[j] > 0 and (best is None or gain[j] > best[0]):
                best = (gain[j], i, j)
    if best is None or best[0] <= g.sum() ** 2 / (h.sum() + 1) + 1e-9:
        if path:
            yield path, float(np.clip(g.sum() / (h.sum() + 1), -4, 4)), members
        return
    _, i, j = best
    if path:
        yield path, 0.0, None
    for over in (False, True):
        side, all_side = (binned[rows, i] > j) == over, (binned[members, i] > j) == over
        yield from _tree(binned, bounds, gradient, curvature, rows[side], members[all_side], (*path, (i, over, float(bounds[i][j]))), depth - 1)


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1 logistic regression, by accelerated proximal gradient steps."""
    n = len(y)
    mean, scale = x.mean(0), np.maximum(x.std(0), 0.05)
    a = np.column_stack(((x - mean) / scale, np.ones(n)))
    step = 4 * n / max(1e-9, np.linalg.norm(a, 2) ** 2)
    w = v = np.append(np.zeros(x.shape[1]), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    momentum = 1.0
    for _ in range(rounds):
        u = v - step * (a.T @ (sigmoid(a @ v) - y)) / n
        u[:-1] = np.sign(u[:-1]) * np.maximum(np.abs(u[:-1]) - step * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v = u + (momentum - 1) / after * (u - w)
        done = np.abs(u - w).max() < 1e-6
        w, momentum = u, after
        if done:
            break
    weights = w[:-1] / scale
    return weights, float(w[-1] - weights @ mean)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", train: Column | None = None, sample: int = SAMPLE) -> Ensemble:
    """A rule ensemble from about ``sample`` labelled texts."""
    rows = statistics(labelled(docs, labels, label, train, sample), ["label"]).toPandas()  # a bounded sample's statistics
    y = rows["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return Ensemble([], [], float(np.log(share / (1 - share))))
    x = rows[[f"stat_{s}" for s in STATS]].to_numpy()
    order = np.lexsort(x.T)  # the same order however the rows came
    x, y = x[order], y[order]
    rules = grow_rules(x, y)
    if not rules:
        return Ensemble([], [], float(np.log(y.mean() / (1 - y.mean()))))
    weights, intercept = lasso_logistic(rule_matrix(x, rules), y, LASSO)
    kept = np.flatnonzero(np.abs(weights) > 1e-9)
    return Ensemble([rules[i] for i in kept], weights[kept].tolist(), intercept)


def scores(docs: DataFrame, ensemble: Ensemble) -> DataFrame:
    """doc_id and score of every row."""
    return statistics(docs, ["doc_id"]).select("doc_id", ensemble.column().alias("score"))


def drop_poor(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents with a score of ``threshold`` or more, learnt from all labels."""
    ensemble = learn(docs, labels)
    return _counted(docs, docs.columns).where(ensemble.column() >= threshold).select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(docs.columns)])
