"""Chat formatting, neighbours and the classifiers, and the pipeline's stages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import ann, chat, quality, queries, toxicity

STATES = {"system": 1, "user": 2, "assistant": 3}


def least_cost(roles):
    best = {0: 0}
    for r in map(chat.known_role, roles):
        now = {}
        for at, cost in best.items():
            for new in STATES:
                change = 0 if new == r else chat.COSTS["relabel"] if r else chat.COSTS["name"]
                for put in ((), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")):
                    s, ok = at, True
                    for m in (*put, new):
                        ok &= (m == "system" and s == 0) or (m == "user" and s in (0, 1, 3)) or (m == "assistant" and s == 2)
                        s = STATES[m]
                    if ok:
                        now[s] = min(now.get(s, 9**9), cost + change + chat.COSTS["insert"] * len(put))
                if STATES[new] == at:
                    now[at] = min(now.get(at, 9**9), cost + chat.COSTS["merge"] + change)
        best = now
    return min(c + {1: 6, 2: 3, 3: 0}[s] for s, c in best.items())


@pytest.mark.parametrize("segment", [2048, 3])
def test_chats(spark, monkeypatch, segment):
    monkeypatch.setattr(chat, "SEGMENT", segment)
    rng = random.Random(segment)
    rows = []
    for conv in range(25):
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, turn if rng.random() < 0.9 else 0, rng.choice(["user", "assistant", "system", "User ", "bot", None]), rng.choice(["hi", "", None, "a\nb"])))
    rows += [(None, None, "user", "x"), (99, 0, "user", "same"), (99, 0, "user", "same")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, segment int")
    got = chat.format_chats(df).collect()
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        out = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: (r["segment"], r["place"], r["part"]))
        text = "".join(r["rendered"] for r in out)
        roles = [m.split("\n")[0] for m in text.split("<|im_start|>")[1:]]
        body = roles[1:] if roles[0] == "system" else roles
        assert body and len(body) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(body))
        assert text.count("<|im_end|>\n") == len(roles) and text.endswith("<|im_end|>\n")
        assert sum(r["cost"] for r in out) == least_cost([r[2] for r in own])
        assert [r["turn"] for r in out if r["action"] != "insert"] == [r[1] for r in own]
    assert chat.format_chats(df.where("false")).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, buckets string")


def nearest(rows, query, k):
    at = dict(rows)
    q = np.array(at[query], np.float32).astype(float)
    found = sorted((float(np.sqrt(((np.array(v, np.float32).astype(float) - q) ** 2).sum())), i) for i, v in rows if i != query)
    return found[:k]


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "TASK_ROWS", 40)  # buckets are cut into parts
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=20) + 3 * np.eye(20)[i % 4]).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(120)]  # a hot vector, with ties
    odd = [(5000, None), (5100, [0.0] * 20), (5200, [float("nan")] * 20), (5300, [None] * 20), (5400, [1.0, 2.0]), (5500, [float("inf")] * 20)]
    got = ann.search(vectors(spark, rows + odd), F.col("vec_id") % 100 == 0, k=10).collect()
    queries_ = sorted({r["query_id"] for r in got})
    assert queries_ == [i for i, _ in rows if i % 100 == 0]
    hits = 0
    for q in queries_:
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        want = nearest(rows, q, 10)
        assert [r[0] for r in own] == list(range(1, 11))
        assert [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        hits += len({v for _, v, _ in own} & {i for _, i in want})
    assert hits >= 0.9 * 10 * len(queries_)
    few = rows[:4]
    got = ann.search(vectors(spark, few), F.col("vec_id") % 100 == 0, k=10).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(i, pytest.approx(s)) for s, i in nearest(few, 0, 10)]
    assert ann.search(vectors(spark, []), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("copies", [30, 1500])  # within a part of a batch, and over several
def test_repeated_ids_take_one_place(spark, copies):
    rng = np.random.default_rng(3)
    near = np.eye(20)[0]
    rows = [(i, (near + 0.05 * rng.normal(size=20)).astype(np.float32).tolist()) for i in range(40)]
    hot = [(50 + i % 2, (near + 0.01 * rng.normal(size=20)).astype(np.float32).tolist()) for i in range(2 * copies)]
    least = {}
    for i, v in rows + hot:
        d = float(np.sqrt(((np.array(v, np.float32).astype(float) - np.array(rows[0][1], np.float32).astype(float)) ** 2).sum()))
        least[i] = min(least.get(i, d), d)
    want = sorted((d, i) for i, d in least.items() if i != 0)
    for k in (5, 60):  # fewer than there are, and more
        got = ann.search(vectors(spark, hot + rows), F.col("vec_id") == 0, k=k).collect()
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got)
        assert [r[0] for r in own] == list(range(1, min(k, 41) + 1)) and len({v for _, v, _ in own}) == len(own)
        assert [(v, s) for _, v, s in own] == [(i, pytest.approx(d)) for d, i in want[:k]]


def test_hadamard_is_an_isometry():
    x = np.random.default_rng(1).normal(size=(5, 16))
    y = ann.hadamard(x)
    assert np.allclose((x**2).sum(1), (y**2).sum(1)) and np.allclose(ann.hadamard(y), x)


def test_recall_on_the_tables(spark, data):
    got = queries.op6_cross_polytope(spark, data).collect()
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    recall = [len({r["vec_id"] for r in got if r["query_id"] == q} & {i for _, i in nearest(rows, q, 10)}) / 10 for q in {r["query_id"] for r in got}]
    assert np.mean(recall) >= 0.9


@pytest.mark.parametrize(("text", "folded"), [("IDIOT!", " idiot  "), ("1d10t", " idiot "), ("іdіоt", " idiot "), ("id​iot", " idiot "), ("ｉｄｉｏｔ", " idiot "), ("$tup1d", " stupid "), ("", "  "), ("é-b", " é b ")])
def test_folding(text, folded):
    assert toxicity.fold(text) == folded


def test_exceptions_spare():
    matcher = toxicity.automaton((("kill", 2.0), ("scum", 3.0)), ("process kill",))
    assert [w for _, w in toxicity.hits(toxicity.fold("K1LL the process; process kills, skill scum"), matcher)] == [2.0, 3.0]


def labelled_docs(spark, n=600):
    rng = random.Random(7)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        toxic, good = i % 6 == 0, i % 5 != 0
        if toxic:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(["zoxxer", "Z0xxed", "vargle"])
        if not good:
            w = [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w), 0))
        labels.append((i, int(good), int(toxic)))
    docs += [(9000, None, 0), (9001, "", 0), (9002, "a" * 200_000, 0), (None, "b c", 0), (3, docs[3][1], 0)]
    labels += [(None, 1, 0), (9000, None, None), (3, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, label int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_classifiers(spark):
    docs, labels, rows = labelled_docs(spark)
    train = F.col("doc_id") % 4 != 2
    lexicon = toxicity.learn(docs, labels, train=train)
    assert any(t.startswith("vargl"[: len(t)]) for t in lexicon.weights)
    ensemble = quality.learn(docs, labels, train=train)
    assert 0 < len(ensemble.rules) < 200
    for scored, at in ((toxicity.scores(docs, lexicon), 2), (quality.scores(docs, ensemble), 1)):
        got = scored.collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
        held = [(r["score"] >= 0.3, rows[r["doc_id"]][at]) for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and r["doc_id"] % 4 == 2]
        assert np.mean([p == y for p, y in held]) > 0.97
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 480 < kept.count() < 520
    named = docs.withColumn("stat_log_bytes", F.lit(-5.0)).withColumn("kept_0", F.lit("x")).withColumn("score", F.lit(9)).withColumn("weight", F.lit("w"))
    for drop in (quality.drop_poor, toxicity.drop_toxic):  # names that the operators use themselves
        left = drop(named, labels)
        assert left.columns == named.columns and 400 < left.count() < docs.count()
        assert left.select("stat_log_bytes", "kept_0", "score", "weight").distinct().collect() == [(-5.0, "x", 9, "w")]


def test_every_telling_term_and_phrase_is_learnt(spark):
    letters = "bcdfghjklmnpqrstuvwx"
    names = [a + b + c for a in letters for b in letters for c in letters]
    terms = [n + "zzzzzzzzz" for n in names[:600]]  # ten beginnings each
    before = [n + "q" for n in names[600:610]]
    spared = [f"{b} {t}" for b in before for t in terms]
    texts = [" ".join(terms)] * 40 + [" ".join(spared)] * 3 + [" ".join(n + "y" for n in names[1000:3000])] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(len(texts))], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    assert all(any(t.startswith(w) for w in lexicon.weights) for t in terms)
    assert len(lexicon.exceptions) > 5000


def test_what_is_called_toxic_is_dropped(spark, monkeypatch):
    docs, labels, _ = labelled_docs(spark, 20)
    for score in (0.29, 0.3, 0.4, 0.6):
        lexicon = toxicity.Lexicon({}, prior=score)
        monkeypatch.setattr(toxicity, "learn", lambda *_, known=lexicon: known)
        called = queries._predicted(toxicity.scores(docs, lexicon), F.lit(True)).where("predicted = 0").count()
        assert toxicity.drop_toxic(docs, labels).count() == called == (docs.count() if score < 0.3 else 0)


def test_classifiers_without_labels(spark):
    docs, labels, _ = labelled_docs(spark, 20)
    none = labels.where("false")
    assert {r["score"] for r in toxicity.scores(docs, toxicity.learn(docs, none)).collect()} == {0.5}
    assert {round(r["score"], 9) for r in quality.scores(docs, quality.learn(docs, none)).collect()} == {0.5}
    ones = labels.where("toxic = 0")
    assert {r["score"] for r in toxicity.scores(docs, toxicity.learn(docs, ones)).collect()} == {0.0}
    assert toxicity.scores(docs.where("false"), toxicity.learn(docs, labels)).count() == 0
    assert quality.scores(docs.where("false"), quality.learn(docs, labels)).count() == 0


def test_rules_mean_the_same_in_spark(spark):
    docs, labels, _ = labelled_docs(spark, 200)
    ensemble = quality.learn(docs, labels)
    stats = quality.statistics(docs, ["doc_id"])
    rows = stats.select(*[f"stat_{s}" for s in quality.STATS], ensemble.column().alias("score")).toPandas()
    z = quality.rule_matrix(rows.iloc[:, :-1].to_numpy(), ensemble.rules) @ np.array(ensemble.weights) + ensemble.intercept
    assert np.allclose(1 / (1 + np.exp(-z)), rows["score"])


def test_statistics_of_plain_cases(spark):
    docs = spark.createDataFrame([(1, "Ab ab cd\ncd! x|y"), (2, None), (3, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in quality.statistics(docs, ["doc_id"]).collect()}
    r = rows[1]
    assert r["stat_upper_share"] == 1 / 16 and r["stat_bars_share"] == 1 / 16 and r["stat_distinct_words"] == 4 / 5
    assert r["stat_repeats"] == 1 / 5 and r["stat_top_word"] == 2 / 5 and r["stat_words_per_line"] == 2.5 and r["stat_odd_ends"] == 1 / 5
    assert all(rows[k][f"stat_{s}"] == 0 for k in (2, 3) for s in quality.STATS)


def test_pipeline_stages(spark, data):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.write_table(stage(spark, docs, data), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert left < ids
        ids = left
    packed = corpus_pipeline.pack(spark, docs, data)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == ids
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, data).select("doc_id").collect()} == ids
