import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.operators import chunk
from siltstone.operators.chunk import Parameters
from siltstone.streaming.ingest import advance


def brute(data: bytes, p: Parameters) -> list[tuple[int, int]]:
    """Byte by byte, stride by stride."""
    out, start, at = [], 0, 0
    while at + p.stride <= len(data):
        at += p.stride
        if at - start >= p.window and sum(data[at - p.window : at]) % p.modulus == p.marker:
            out.append((start, at))
            start = at
    return [*out, (start, len(data))]


@pytest.mark.parametrize(("data", "p", "expected"), [(bytes([1, 0, 4, 5, 9, 0, 0, 3, 6, 7]), Parameters(1, 2, 3, 1), [(0, 2), (2, 4), (4, 6), (6, 9), (9, 10)]), (b"banana", Parameters(1, 1, 8, ord("n")), [(0, 3), (3, 5), (5, 6)]), (b"", Parameters(), [(0, 0)]), (b"z", Parameters(1, 1, 8, ord("z")), [(0, 1), (1, 1)])])
def test_vectors(data, p, expected):
    assert chunk.split(data, p) == expected


@given(st.binary(max_size=300), st.integers(1, 3), st.integers(1, 5), st.integers(1, 4))
@settings(max_examples=300)
def test_equals_brute_force(data, stride, strides, log2):
    p = Parameters(stride, strides, log2, 1)
    ranges = chunk.split(data, p)
    assert ranges == brute(data, p)
    assert b"".join(data[a:b] for a, b in ranges) == data


@given(st.binary(min_size=1, max_size=200), st.integers(2, 5))
def test_earlier_variant(data, window):
    out, start = [], 0
    while start < len(data):
        cut = next((start + i for i in range(window, len(data) - start) if sum(data[start + i - window + 1 : start + i + 1]) % 8 == 1), len(data))
        out.append((start, cut))
        start = cut
    assert chunk.split_before(data, window, 3, 1) == out


@given(st.lists(st.integers(0, 255), max_size=400))
def test_groups_of_items(sigs):
    out, start = [], 0
    while start < len(sigs):
        end = next((start + i + 1 for i in range(32, len(sigs) - start) if sum(sigs[start + i - 3 : start + i + 1]) % 128 == 1), len(sigs))
        out.append((start, end))
        start = end
    assert chunk.group_items(np.array(sigs, np.int64)) == out


def test_hierarchy_ends_at_the_limit():
    levels = chunk.hierarchy(np.random.default_rng(1).integers(0, 256, 60000).tolist())
    assert levels and len(levels[-1]) <= 1024 and levels[0][-1][1] == 60000
    assert chunk.hierarchy([1, 2, 3]) == []


@pytest.mark.parametrize(("byte", "size"), [(42, 1024), (7, 1_000_000), (13, 1_000_000)])
def test_constant_bytes_are_one_chunk(byte, size):
    assert chunk.split(bytes([byte]) * size, Parameters()) == [(0, size)]


def test_engine_ways_agree(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(0, 256, n).astype(np.uint8).tobytes()) for i, n in enumerate((0, 1, 40, 500, 2000))] + [(9, None)]
    df = spark.createDataFrame(rows, "id int, data binary")
    p = Parameters(1, 16, 4, 1)
    kernel = {r["id"]: r["e"] for r in chunk.chunks(df, ["id"], "data", p).groupBy("id").agg(F.array_sort(F.collect_list("end")).alias("e")).collect()}
    assert 9 not in kernel
    ends = chunk.candidate_ends(df, ["id"], "data", p).groupBy("id").agg(F.array_sort(F.collect_list("end")).alias("e"))
    folded = {r["id"]: r["c"] for r in ends.select("id", chunk.chosen_cuts(F.col("e"), 16).alias("c")).collect()}
    for i, data in rows[:-1]:
        want = [b for _, b in chunk.split(data, p)]
        assert kernel[i] == want
        assert folded.get(i, []) == want[:-1]


@pytest.mark.parametrize("p", [Parameters(1, 16, 4, 1), Parameters(3, 5, 3, 1), Parameters(1, 1, 3, 1)])
def test_long_streams_are_chunked_as_one_value(spark, p):
    rng = np.random.default_rng(5)
    rows = [(k, i, None if n % 11 == 0 else rng.integers(0, 256, n).astype(np.uint8).tobytes()) for k, m in (("hot", 120), ("b", 7), (None, 9), ("short", 1)) for i, n in enumerate(rng.integers(0, 40, m).tolist())]
    rows += [("empty", 0, b""), ("null", 0, None), ("null", 1, None)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows)).tolist()], "k string, at int, data binary")
    whole = {k: b"".join(d or b"" for name, _, d in rows if name == k) for k in {r[0] for r in rows}}
    want = []
    for k, data in whole.items():
        ranges = chunk.split(data, p)
        want += [(k, i, a, b) for i, (a, b) in enumerate(ranges) if b > a or len(ranges) == 1]
    key = lambda r: (r[0] is None, r[0] or "", r[1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        got = [tuple(r) for r in chunk.long_chunks(df, ["k"], "at", "data", p).collect()]
        assert chunk.long_chunks(df.where("false"), ["k"], "at", "data", p).collect() == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert sorted(got, key=key) == sorted(want, key=key)


@given(st.binary(max_size=400), st.lists(st.integers(0, 400), max_size=6))
def test_streamed_chunks_are_those_of_the_whole(data, cuts):
    p = Parameters(1, 8, 3, 1)
    at = [0, *sorted(min(c, len(data)) for c in cuts), len(data)]
    state, out = (0, 0, b""), []
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        state, found = advance(state, data[a:b], p, i == len(at) - 2)
        out += found
    whole = [r for r in chunk.split(data, p) if r[1] > r[0]] or [(0, 0)]
    assert [(s, e) for _, s, e, _ in out] == whole
    assert [o for o, *_ in out] == list(range(len(out)))
    assert b"".join(blob for *_, blob in out) == data


@pytest.mark.parametrize("rule", [{"minimum": 4, "window": 4, "log2_modulus": 3}, {"minimum": 1, "window": 9, "log2_modulus": 2}, {"minimum": 3, "window": 1, "log2_modulus": 3}])
def test_groups_of_a_stream_dealt_over_many_tasks(spark, rule):
    signatures = np.random.default_rng(5).integers(0, 256, 700)
    rows = [("a", i, int(v)) for i, v in enumerate(signatures)] + [("b", i, int(v)) for i, v in enumerate(signatures[:5])] + [(None, 0, 1)]
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "150")  # pieces shorter than a window
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = chunk.group_rows(spark.createDataFrame(rows, "k string, i long, s int"), ["k"], "i", "s", **rule)
        rows = found.withColumn("task", F.spark_partition_id()).collect()
        assert len({r["task"] for r in rows if r["k"] == "a"}) > 20  # a window over the stream would be one task
        got = {(r["k"], r["i"]): r["group"] for r in rows}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    want = {("a", i): g for g, (x, y) in enumerate(chunk.group_items(signatures, **rule)) for i in range(x, y)}
    want |= {("b", i): g for g, (x, y) in enumerate(chunk.group_items(signatures[:5], **rule)) for i in range(x, y)}
    assert got == want | {(None, 0): 0}
