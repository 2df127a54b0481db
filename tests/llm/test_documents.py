"""The operators on documents against plain versions, on small tables with nulls, empties, copies and clashing columns."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_words_tokens import thue_morse, word_lists

from siltstone.llm import ctw, decontamination, minhash, packing, records, sharding
from siltstone.llm.tokens import encoder, vocabulary_path

SCHEMA = "doc_id long, text string, length int, shard string, hash string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 120))] for _ in range(n)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for k in range(25):  # near copies of one text, and of others
        w = list(base[0] if k < 15 else rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((1000 + k, "  ".join(w).upper()))
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "one"), (2004, "one"), (2005, "One two"), (2006, rows[3][1]), (2006, rows[3][1]), (None, rows[3][1]), (2007, "x " * 9000)]
    return rows


def sets_of(rows, width=5):
    out = []
    for w in word_lists([t for _, t in rows]):
        out.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset()))
    return out


@pytest.mark.parametrize(("num", "den", "block"), [(85, 100, 3_000_000), (4, 5, 3_000_000), (4, 5, 900)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, num, den, block):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)  # small blocks: families are compared in several tasks
    rows = [r for r in corpus() if r[0] is not None]
    sets = sets_of(rows)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and den * both >= num * (len(x) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    want = sorted((doc, len(sets[i]), least[root(i)] if sets[i] else doc) for i, (doc, _) in enumerate(rows))
    got = minhash.near_duplicates(make(spark, rows), num, den).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_texts_of_one_pattern_are_different(spark):
    x, y = thue_morse("a", "b")
    rows = [(1, x), (2, y), (3, x), (4, f"one two three {x} five"), (5, f"one two three {y} five")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(make(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    scored = {r["doc_id"]: (r["n_known"], r["base_score"]) for r in ctw.score(make(spark, rows), F.col("doc_id").isin(2, 5), depth=2).collect()}
    assert scored[1][0] == 2 and scored[2][0] == 1 and scored[5][0] == scored[4][0] - 1  # y is in no training text
    bench = spark.createDataFrame([(7, x), (8, f"one two three {y} five")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.matches(make(spark, rows), bench).collect()}
    assert found == {(1, 7), (3, 7), (4, 7), (5, 8)}
    assert [len(f) for f in (minhash.flood([(np.array([1, 2], np.uint64), np.array([1, z], np.uint64)) for z in (2, w)], None, 32, 4, 5) for w in (2, 3))] == [1, 0]


def test_near_duplicates_of_null_ids_and_nothing(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (None, "q r s")]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(make(spark, rows)).collect()}
    assert got == {(None, 3, False), (3, 3, True), (None, None, False)}
    assert minhash.near_duplicates(make(spark, [])).count() == 0
    kept = minhash.drop_near_duplicates(make(spark, [*rows, (9, "A B c d e f")]))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")] and sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "None", "None"]


def test_one_row_of_a_component_stays(spark):
    same, other = "a b c d e f", "q r s t u v"
    rows = [(3, same), (3, same), (3, "A  b c d e f"), (9, same), (None, same), (9, "a text of its own"), (None, other), (None, other), (None, None), (None, ""), (12, ""), (12, "")]
    docs = make(spark, rows).repartition(3)
    kept = sorted(((r["doc_id"], (r["text"] or "").lower().split()) for r in minhash.drop_near_duplicates(docs, spare_unnamed=False).collect()), key=str)
    want = [(3, same), (9, "a text of its own"), (None, other), (None, ""), (None, ""), (12, ""), (12, "")]
    assert kept == sorted(((i, t.split()) for i, t in want), key=str)
    spared = Counter(r["doc_id"] for r in minhash.drop_near_duplicates(docs).collect())
    assert spared == {3: 1, 9: 1, None: 5, 12: 2}


def test_texts_without_ids_link_others(spark):
    w = [f"w{i}" for i in range(120)]
    a, b, c = " ".join(w), " ".join([*w[10:], *"abcdefghij"]), " ".join([*w[20:], *"abcdefghij", *"klmnopqrst"])
    rows = [(2, a), (None, b), (5, c), (None, "x " + a.upper()), (None, " ".join(f"v{i}" for i in range(99))), (None, " ".join(f"v{i}" for i in range(1, 99)))]
    docs = make(spark, rows)
    got = Counter((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs).collect())
    assert got == {(2, 2): 1, (5, 2): 1, (None, 2): 2, (None, None): 2}
    kept = minhash.drop_near_duplicates(docs, spare_unnamed=False).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["2", "None"]


def test_the_pipeline_drops_copies_without_ids(spark, data):
    import corpus_pipeline

    docs = make(spark, [(None, "a b c d e f"), (None, "A b c d e f"), (7, "a b c d  e f"), (None, "q r s"), (None, "q r s")])
    assert sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, data).collect()), key=str) == [(7, "a b c d  e f"), (None, "q r s")]


def test_the_flood_filter_keeps_what_is_similar():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = []
    for _ in range(120):
        keep = rng.random(400) > rng.choice([0.02, 0.05, 0.1])
        sets.append(np.unique(np.concatenate((base[keep], rng.integers(0, 2**63, int((~keep).sum()), dtype=np.uint64)))))
    sets.sort(key=len)
    parent = list(range(len(sets)))
    other = list(range(len(sets)))

    def root(p, i):
        while p[i] != i:
            i = p[i]
        return i

    for u, v in minhash.flood([(s, s) for s in sets], None, 32, 85, 100):
        parent[root(parent, u)] = root(parent, v)
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                other[root(other, i)] = root(other, j)
    pairs = lambda p: {(i, j) for i in range(len(sets)) for j in range(i) if root(p, i) == root(p, j)}
    assert pairs(parent) == pairs(other)


@pytest.mark.parametrize(("num", "den"), [(85, 100), (4, 5)])
def test_the_flood_filter_asks_for_no_more_than_the_lists(num, den):
    k, size = 32, 100
    shared = minhash.least_overlap(k, num / den)
    both = size * 2 * num // (den + num) + 1  # as many shared hashes as the threshold needs
    low = np.arange(shared, dtype=np.uint64)
    own = [100 + 2 * np.arange(k - shared, dtype=np.uint64) + np.uint64(i) for i in range(2)]
    rest = 10_000 + np.arange(both - shared, dtype=np.uint64)
    fill = [20_000 * (i + 1) + np.arange(max(0, size - both - (k - shared)), dtype=np.uint64) for i in range(2)]
    sets = [np.sort(np.concatenate((low, own[i], rest, fill[i])).astype(np.uint64)) for i in range(2)]
    common = len(np.intersect1d(*sets))
    union = len(np.union1d(*sets))
    num, den = common, union  # at exactly their similarity
    assert [len(x) for x in minhash.flood([(s, s) for s in sets], None, k, num, den)] == [2]


def test_packing(spark):
    rows = corpus()
    path = vocabulary_path("word_bpe_49k.json")
    got = packing.pack(make(spark, rows), path, 64).collect()
    enc = encoder(path)
    ids = Counter()
    for doc, t in rows:
        x = [*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(x), 64):
            part = np.array(x[k : k + 64], "<u4")
            ids[doc, k // 64, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == ids
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= -(-sum(r["length"] for r in got) // 64) * 1.02  # of a bound that no packing may reach
    assert packing.pack(make(spark, []), path, 64).count() == 0
    distinct = [(i, t) for i, t in rows if i is not None and i < 40]
    seqs = packing.sequences(make(spark, distinct), path, 64).collect()
    assert sum(len(r["ids"]) for r in seqs) == sum(len(enc.tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in distinct)


def test_bins_hold_every_document_once():
    rng = np.random.default_rng(0)
    for _ in range(20):
        counts = np.bincount(rng.integers(1, 65, rng.integers(1, 400)), minlength=65)
        left = counts.copy()
        for repeats, items in packing.plan_bins(counts, 64):
            assert repeats > 0 and sum(n * length for length, n in items) <= 64
            for length, n in items:
                left[length] -= repeats * n
        assert not left.any()


def test_two_replace_the_smallest_where_that_is_tighter():
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = 1, 1, 2  # greedy: 6 + 3, gap 1; then 3 gives way to 2 + 2
    assert packing.plan_bins(counts, 10)[0] == (1, [(6, 1), (2, 2)])


def test_records_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "partitions_for", lambda df, target: 4)
    rows = corpus()
    path = vocabulary_path("byte_bpe_50k.json")
    manifest = records.write_records(make(spark, rows), path, f"file://{tmp_path}/r")
    got = records.read_records(spark, manifest).collect()
    enc = encoder(path)
    want = Counter((doc, *enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 0) for doc, t in rows)
    assert Counter((r["doc_id"], *r["ids"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order[0] is None and order[1:] == sorted(order[1:])
    shard = manifest.first()
    some = records.read_some(shard["path"], [shard["records"] - 1, 0])
    assert len(some) == 2
    with open(shard["path"].removeprefix("file://") + ".rec", "r+b") as f:
        f.seek(20)
        f.write(b"\xff\xff")
    with pytest.raises(ValueError):
        records.read_some(shard["path"], [0])
    assert records.read_records(spark, records.write_records(make(spark, []), path)).count() == 0


def test_sharding(spark):
    rows = [*corpus(), *((5000 + i, "t") for i in range(500))]
    got = sharding.assign(make(spark, rows), 7, vnodes=16).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(7)}
    assert all(x == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = {(r["doc_id"], r["shard"]) for r in sharding.assign(make(spark, rows[::-1]).repartition(3), 7, vnodes=16).collect()}
    assert {(r["doc_id"], r["shard"]) for r in got} == again
    assert sharding.assign(make(spark, []), 7).count() == 0


def test_bounded_loads_move_little():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, 20_000)

    def owner_of(shards, epsilon):
        points, owner = sharding.ring(shards, 128)
        arcs = np.searchsorted(points, np.sort(keys)) % len(points)
        counts = np.bincount(arcs, minlength=len(points))
        segments = sharding.plan_arcs(counts, owner, sharding.capacities(len(keys), shards, epsilon))
        rank = np.arange(len(arcs)) - np.searchsorted(arcs, arcs) if (np.diff(arcs) >= 0).all() else np.array([np.sum(arcs[:i] == a) for i, a in enumerate(arcs)])
        return segments[np.searchsorted(segments[:, 0], arcs.astype(np.int64) << 40 | rank, "right") - 1, 2]

    a, b = owner_of(24, 0.1), owner_of(25, 0.1)
    assert np.bincount(a).max() <= math.ceil(20_000 / 24 * 1.1) + 1
    assert (a != b).mean() < 0.2


def test_context_tree_equals_recursion():
    rng = np.random.default_rng(5)
    depth = 2
    stream = np.concatenate((np.full(depth, 10), rng.choice([97, 98, 32, 225], 400, p=[0.5, 0.2, 0.2, 0.1]))).astype(np.uint8)
    codes = ctw.codes(stream, depth)
    keys, n = np.unique(codes, return_counts=True)
    levels = ctw.build(keys, n, depth, 0)
    count = {}
    for at in range(depth, len(stream)):
        bits = [(int(stream[at]) >> (7 - j)) & 1 for j in range(8)]
        for d in range(depth + 1):
            ctx = tuple(int(x) for x in stream[at - d : at][::-1])
            for j, bit in enumerate(bits):
                count.setdefault((ctx, tuple(bits[:j])), [0, 0])[bit] += 1

    def kt(c):
        a, b = c
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def pw(ctx, node):
        own = kt(count[ctx, node])
        if len(ctx) == depth:
            return own
        below = sum(pw((*ctx, c), node) for c in range(256) if ((*ctx, c), node) in count)
        return math.log(0.5 * math.exp(own) + 0.5 * math.exp(below)) if own > -600 else np.logaddexp(own, below) - math.log(2)

    def predict(ctx, node, bit, at):
        c = count[ctx, node]
        own = (c[bit] + 0.5) / (sum(c) + 1)
        if len(ctx) == depth or ((*ctx, at[len(ctx)]), node) not in count:
            return own
        w = math.exp(kt(c) - math.log(2) - pw(ctx, node))
        return w * own + (1 - w) * predict((*ctx, at[len(ctx)]), node, bit, at)

    got = ctw.log10_probability(codes, depth, levels)
    for k in (depth, 50, 200, 399):
        at = k + 0
        ctx = [int(x) for x in stream[at - depth : at][::-1]]
        bits = [(int(stream[at]) >> (7 - j)) & 1 for j in range(8)]
        want = sum(math.log10(predict((), tuple(bits[:j]), b, ctx)) if ((), tuple(bits[:j])) in count else math.log10(0.5) for j, b in enumerate(bits))
        assert got[at - depth] == pytest.approx(want, rel=1e-9)
    every = np.arange(256, dtype=np.uint64) | codes[7] >> np.uint64(8) << np.uint64(8)
    assert (10.0 ** ctw.log10_probability(every, depth, levels)).sum() == pytest.approx(1)
    top = levels[1]
    up = ctw.top_levels([(int(k), int(a), int(b), float(s)) for k, a, b, s in zip(top.keys, top.n0, top.n1, np.bincount(np.searchsorted(top.keys, ctw.parents(levels[2].keys)), levels[2].log_pw, len(top.keys)), strict=True)])
    assert np.allclose(up[0].share, levels[0].share) and np.allclose(up[1].share, levels[1].share)


def test_scores_equal_the_recursion_from_text_to_score(spark, monkeypatch):
    monkeypatch.setattr(ctw, "CHUNK_BYTES", 40)
    monkeypatch.setattr(ctw, "ASKED_AT_ONCE", 20)
    rows = [(1, "ab Abc"), (2, "abc  ab ab"), (3, None), (4, "ab é"), (5, "zq ab"), (6, "ab Abc"), (None, "abé")]
    held, depth = {2, 5}, 2
    streams = [b"\n" * depth + b"".join(x + b" " for x in w) + b"\n" for w in word_lists([t for _, t in rows])]
    count = {}

    def decisions(stream, at):
        bits = [(stream[at] >> (7 - j)) & 1 for j in range(8)]
        return [(tuple(bits[:j]), b) for j, b in enumerate(bits)], stream[at - depth : at][::-1]

    for (doc, _), stream in zip(rows, streams, strict=True):
        for at in range(depth, len(stream)) if doc not in held else ():
            made, before = decisions(stream, at)
            for d in range(depth + 1):
                for node, bit in made:
                    count.setdefault((before[:d], node), [0, 0])[bit] += 1

    def pe(c):
        return math.exp(math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.lgamma(sum(c) + 1) - math.log(math.pi))

    def pw(ctx, node):
        below = [pw(ctx + bytes([c]), node) for c in range(256) if (ctx + bytes([c]), node) in count] if len(ctx) < depth else []
        return 0.5 * pe(count[ctx, node]) + 0.5 * math.prod(below) if len(ctx) < depth else pe(count[ctx, node])

    def predict(before, d, node, bit):
        c = count.get((before[:d], node))
        if c is None:
            return 0.5
        own = (c[bit] + 0.5) / (sum(c) + 1)
        if d == depth or (before[: d + 1], node) not in count:
            return own
        w = 0.5 * pe(c) / pw(before[:d], node)
        return w * own + (1 - w) * predict(before, d + 1, node, bit)

    want = {}
    for (doc, _), stream in zip(rows, streams, strict=True):
        steps = [decisions(stream, at) for at in range(depth, len(stream))]
        want[doc] = sum(math.log10(predict(before, 0, node, bit)) for made, before in steps for node, bit in made)
    got = {r["doc_id"]: r["score"] for r in ctw.score(make(spark, rows).repartition(2), F.col("doc_id").isin(*held), depth=depth).collect()}
    assert got == {k: pytest.approx(v, rel=1e-5) for k, v in want.items()}


def test_large_counts_use_stirling():
    n = np.array([65535, 65536, 70000, 3_000_000])
    assert np.allclose(ctw._log_half(n), [math.lgamma(x + 0.5) - math.lgamma(0.5) for x in n], rtol=1e-12)
    assert np.allclose(ctw._log_fact(n), [math.lgamma(x + 1) for x in n], rtol=1e-12)


@pytest.mark.parametrize("chunks", [5, 1])
def test_scores(spark, monkeypatch, chunks):
    monkeypatch.setattr(ctw, "CHUNKS_A_TASK", 2)
    monkeypatch.setattr(ctw, "partitions_for", lambda df, target: chunks)
    monkeypatch.setattr(ctw, "BUCKETS", 16)
    monkeypatch.setattr(ctw, "CHUNK_BYTES", 64 << 20 if chunks == 1 else 2000)
    monkeypatch.setattr(ctw, "ASKED_AT_ONCE", 4 << 20 if chunks == 1 else 100)  # buckets are split into parts
    rows = corpus()
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    got = ctw.score(make(spark, rows), held, depth=3).collect()
    train = [zlib.crc32(str("" if d is None else d).encode()) % 5 != 1 for d, _ in rows]
    lists = [[*w, "end"] for w in word_lists([t for _, t in rows])]
    c = Counter(x for w, t in zip(lists, train, strict=True) if t for x in w)
    total, distinct = sum(c.values()), len(c)
    want = sorted((str(d), not t, len(w), sum(x in c for x in w), round(sum(math.log10((c[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w), 6)) for (d, _), t, w in zip(rows, train, lists, strict=True))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == total and -1e6 < r["score"] < 0 for r in got)
    once = {r["doc_id"]: r["score"] for r in got}
    if chunks > 1:  # the deal into chunks does not change scores
        monkeypatch.setattr(ctw, "partitions_for", lambda df, target: 1)
        monkeypatch.setattr(ctw, "CHUNK_BYTES", 64 << 20)
        whole = {r["doc_id"]: r["score"] for r in ctw.score(make(spark, rows), held, depth=3).collect()}
        assert all(once[k] == pytest.approx(whole[k], rel=1e-5) for k in whole)
    assert ctw.score(make(spark, []), held, depth=3).count() == 0


def test_contamination_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 5, 9, 20, 40])))) for i in range(25)] + [(90, None), (91, ""), (92, "w1 w1 w1 w1 w1 w1 w1 w1")]
    docs = []
    for k in range(60):
        w = [rng.choice(words) for _ in range(rng.randint(1, 60))]
        item = rng.choice(items[:25])[1].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            item[rng.randrange(len(item))] = rng.choice(words)
        at = rng.randint(0, len(w))
        docs.append((k, " ".join([*w[:at], *item, *w[at:]]) if k % 3 else " ".join(item)))
    docs += [(100, None), (101, ""), (102, "W1 " * 12), (103, items[4][1].upper())]

    def shingles(w):
        return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])

    def sim(a, b):
        weight = lambda s: sum(map(len, s))
        least = sum(weight(s) * min(n, b[s]) for s, n in a.items())
        return least / (sum(weight(s) * n for s, n in a.items()) + sum(weight(s) * n for s, n in b.items()) - least)

    want = {}
    lists = word_lists([t for _, t in docs])
    for i, item in zip([i for i, t in items if t], word_lists([t for _, t in items if t]), strict=True):
        for (d, _), w in zip(docs, lists, strict=True):
            n = len(item)
            best = max((sim(shingles(w[k : k + n]), shingles(item)) for k in range(max(1, len(w) - n + 1)) if w), default=0)
            if best >= 0.8:
                want[d, i] = round(best, 9)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    found = decontamination.matches(make(spark, docs), bench)
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in found.collect()} == want
    left = decontamination.drop_contaminated(make(spark, docs), bench)
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    own = decontamination.drop_contaminated(make(spark, [(None, items[4][1]), (1, items[4][1]), (1, "clean"), (None, None)]), bench)
    assert sorted(((r["doc_id"], r["text"]) for r in own.collect()), key=str) == [(1, "clean"), (None, None)]
    assert decontamination.drop_contaminated(make(spark, docs), bench.where("false")).count() == len(docs)
    assert decontamination.matches(make(spark, docs), bench.where("false")).count() == 0
    assert decontamination.matches(make(spark, []), bench).count() == 0


def test_every_fingerprint_within_the_radius_is_found():
    rng = np.random.default_rng(4)
    index = decontamination.Index(list(range(30)), [" ".join(f"a{rng.integers(999)}" for _ in range(12)) for _ in range(30)], 5)
    prints = index.prints[rng.integers(0, 30, 500)]
    for k in range(500):
        for b in rng.permutation(64)[: rng.integers(0, 30)]:
            prints[k] ^= np.uint64(1) << np.uint64(b)
    owner, item = index.within_radius(prints)
    want = {(k, i) for k in range(500) for i in range(30) if int(prints[k] ^ index.prints[i]).bit_count() <= decontamination.RADIUS}
    assert set(zip(owner.tolist(), item.tolist(), strict=True)) == want
