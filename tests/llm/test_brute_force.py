"""Operators against plain versions written row by row: toxicity, text statistics, the ring, the pipeline's stages."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_documents import corpus, make
from test_words_tokens import word_lists

from siltstone.llm import decontamination, minhash, quality, sharding, toxicity
from siltstone.llm.words import slabs

# --- toxicity


def naive_hits(folded, weights, exceptions):
    """Every place is tried with every entry and every phrase."""
    starts = [p for p, c in enumerate(folded) if c == " "]
    spared = {p + len(e) + 1 for p in starts for e in exceptions if folded[p + 1 :].startswith(e)}
    return sorted((p, w) for p in starts for t, w in weights.items() if folded[p + 1 :].startswith(t) and p + len(t) + 1 not in spared)


@given(st.lists(st.sampled_from(["kill", "k1ll", "kills", "skill", "process", "ab", "a", "b", "аb", "ab-ab", "KILL!", "é", "", "\n", "x" * 30]), max_size=14).map(" ".join))
@settings(max_examples=300, deadline=None)
def test_matches_are_those_of_every_place_and_entry(text):
    weights, exceptions = {"kill": 2.0, "ab": 1.0, "xxxxxxxxxxxx": 3.0}, ["process kill", "a ab", "b ab"]
    folded = toxicity.fold(text)
    assert sorted(toxicity.hits(folded, toxicity.automaton(tuple(weights.items()), tuple(exceptions)))) == naive_hits(folded, weights, exceptions)


def test_what_is_learnt_equals_plain_counting(spark):
    rng = random.Random(11)
    plain = ["".join(rng.choice("aeiolmnrst") for _ in range(rng.randint(2, 14))) for _ in range(150)]
    docs, label = [], {}
    for i in range(300):
        w = [rng.choice(plain) for _ in range(rng.randint(1, 40))]
        label[i] = int(i % 4 == 0)
        if label[i]:
            w[rng.randrange(len(w))] = rng.choice(["Zoxxer", "z0xxed", "vargle"])
        elif i % 32 == 1:
            w += ["benign", "zoxxer"]
        docs.append((i, " ".join(w)))
    docs += [(500, None), (501, docs[0][1]), (0, docs[0][1])]
    lexicon = toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*label.items(), (500, 0)], "doc_id long, toxic int"))
    texts = [(toxicity.fold(docs[i][1]), y) for i, y in label.items()] + [(toxicity.fold(""), 0)]
    seen = {1: Counter(), 0: Counter()}
    for folded, y in texts:
        seen[y].update(set(folded.split()))
    pos, neg = (sum(seen[y].values()) for y in (1, 0))
    found = {}
    for w in set(seen[0]) | set(seen[1]):
        for t in {w[:n] for n in range(3, 13) if len(w[:n]) >= 3}:
            a, b = found.get(t, (0, 0))
            found[t] = a + seen[1][w], b + seen[0][w]

    def g2(a, b):
        expected = [(a + b) * n / (pos + neg) for n in (pos, neg)]
        return 2 * sum(x * math.log(x / e) for x, e in zip((a, b), expected, strict=True) if x)

    telling = {t: (a, b) for t, (a, b) in found.items() if a >= 3 and a * neg > 3 * b * pos and g2(a, b) >= 30}
    chosen = {}
    for t in sorted(telling, key=lambda t: (-g2(*telling[t]), -len(t), t)):
        if not any(c.startswith(t) or t.startswith(c) for c in chosen):
            a, b = telling[t]
            chosen[t] = math.log((a + 0.5) / (pos + 1)) - math.log((b + 0.5) / (neg + 1))
    assert chosen and lexicon.weights == {t: pytest.approx(w) for t, w in chosen.items()}
    phrases = {1: Counter(), 0: Counter()}
    for folded, y in texts:
        words = folded.split()
        own = {f"{x} {t}" for x, z in zip(words[:-1], words[1:], strict=True) for t in chosen if z.startswith(t)}
        phrases[y].update(own)
    assert lexicon.exceptions == sorted(p for p, n in phrases[0].items() if n >= 3 and not phrases[1][p])
    assert lexicon.exceptions


# --- text statistics


def plain_statistics(text):
    raw = text.encode()
    words = [w for w in word_lists([text])[0]]
    cased = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, per = len(words), max(1, len(words))
    lines = [x for x in re.findall(rb"[^\n]*\n|[^\n]+", raw.lower())]
    share = lambda codes: sum(b in codes for b in raw) / max(1, len(raw))
    ends = set(b"#$%&*+<=>@\\^_`{|}~/!?")
    return [
        *(share(set(codes)) for codes in quality._CLASSES.values()),
        math.log1p(len(raw)),
        sum(map(len, cased)) / per,
        len(set(words)) / per,
        len(set(zip(words[:-1], words[1:], strict=True))) / max(1, per - 1),
        sum(a == b for a, b in zip(words[:-1], words[1:], strict=True)) / per,
        max(Counter(words).values(), default=0) / per,
        sum(len(w) <= 3 for w in words) / per,
        sum(len(w) > 14 for w in words) / per,
        sum(w[-1] in ends for w in cased) / per,
        n / max(1, len(lines)),
        len(set(lines)) / max(1, len(lines)),
    ]


@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from(list("aAbé \t\n!|9.,#")), max_size=40)), max_size=6), st.integers(1, 64))
@settings(max_examples=200, deadline=None)
def test_statistics_equal_plain_counting(texts, limit):
    import pyarrow as pa

    got = [row for slab in slabs(pa.array(texts, pa.string()), limit) for row in quality.slab_statistics(slab)]
    assert len(got) == len(texts)
    for text, row in zip(texts, got, strict=True):
        assert dict(zip(quality.STATS, row, strict=True)) == {k: pytest.approx(v) for k, v in zip(quality.STATS, plain_statistics(text or ""), strict=True)}


def test_rules_are_paths_of_the_trees():
    """A row is in a rule if and only if each comparison on its path holds, and some rule tells the labels apart."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0.2) & (x[:, 2] <= 0.5)).astype(float)
    rules = quality.grow_rules(x, y, trees=4)
    matrix = quality.rule_matrix(x, rules)
    for k, rule in enumerate(rules):
        assert 1 <= len(rule) <= quality.DEPTH
        assert matrix[:, k].tolist() == [float(all((r[i] > b) == over for i, over, b in rule)) for r in x]
    assert max(abs(np.corrcoef(c, y)[0, 1]) for c in matrix.T if 0 < c.mean() < 1) > 0.9


# --- the ring


@pytest.mark.parametrize(("block", "epsilon"), [(1 << 16, 0.0), (7, 0.0), (1 << 16, 0.25)])
def test_every_row_walks_clockwise(spark, monkeypatch, block, epsilon):
    monkeypatch.setattr(sharding, "BLOCK", block)  # equal rows are told apart in blocks
    rows = [*corpus(), *((None, "same") for _ in range(90)), *((7, f"t{i % 5}") for i in range(60))]
    docs, shards, vnodes = make(spark, rows).repartition(3), 5, 4
    text = F.coalesce("text", F.lit("")).cast("binary")
    keyed = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("crc"))
    keyed = [tuple(r) for r in keyed.withColumn("at", F.xxhash64("doc_id", "size", "crc")).collect()]
    points, owner = sharding.ring(shards, vnodes)
    points = points.tolist()

    def arc(at):
        return next((i for i, p in enumerate(points) if p >= at), 0)

    room = sharding.capacities(len(rows), shards, epsilon).tolist()
    load, want, over = [0] * shards, [], []

    def put(row, s):
        want.append((*row[:3], s, load[s]))
        load[s] += 1

    for row in sorted(keyed, key=lambda r: (arc(r[3]), r[3], r[0] is not None, r[0] or 0, r[1], r[2])):
        s = int(owner[arc(row[3])])
        if load[s] < room[s]:
            put(row, s)
        else:
            over.append(row)
    for row in over:
        step = arc(row[3])
        while load[int(owner[step])] >= room[int(owner[step])]:
            step = (step + 1) % len(points)
        put(row, int(owner[step]))
    got = sharding.assign(docs, shards, vnodes, epsilon).collect()
    assert Counter(tuple(r) for r in got) == Counter(want)


# --- the pipeline


def test_stages_decide_as_their_operators_do(spark, data):
    import corpus_pipeline

    docs = corpus_pipeline.write_table(spark.read.parquet(f"{data}/documents.parquet"), "stage")
    labels, bench = spark.read.parquet(f"{data}/labels.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    def by_quality(d):
        return ids(quality.scores(d, quality.learn(d, labels)).where("score >= 0.3"))

    def by_toxicity(d):
        return ids(toxicity.scores(d, toxicity.learn(d, labels)).where("score < 0.3"))

    def by_copies(d):
        return ids(minhash.near_duplicates(d, 4, 5).where("kept"))

    def by_benchmark(d):
        return ids(d) - ids(decontamination.matches(d, bench))

    for (_, stage), decide in zip(corpus_pipeline.STAGES[:-1], (by_quality, by_toxicity, by_copies, by_benchmark), strict=True):
        left = corpus_pipeline.write_table(stage(spark, docs, data), "stage")
        assert ids(left) == decide(docs) and left.count() == len(ids(left))
        docs = left


def test_the_pipeline_without_benchmark_or_labels(spark, data, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet").limit(40)  # a small fixture
    for name, df in (("documents", docs), ("labels", spark.read.parquet(f"{data}/labels.parquet").where("false")), ("benchmark", spark.read.parquet(f"{data}/benchmark.parquet").where("false"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    # Without labels a text scores 0.5, so toxicity drops all; without these two stages the others keep what is no copy.
    assert got == set()
    kept = corpus_pipeline.drop_leaks(spark, corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)), str(tmp_path))
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in minhash.near_duplicates(docs, 4, 5).where("kept").collect()}
