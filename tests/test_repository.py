import os

import pytest
from pyspark.sql import functions as F

from siltstone.functions.digest import digest_of
from siltstone.operators import batch, files, index
from siltstone.operators.chunk import Parameters
from siltstone.plans.repository import Repository, RepositoryError
from siltstone.sources.store import OBJECTS, Store, StoreError
from siltstone.sources.tables import write_scratch
from siltstone.streaming.ingest import chunk_stream, store_chunks


def objects(spark, *blobs):
    return spark.createDataFrame([(digest_of(b, [], "SHA-2-256"), "SHA-2-256", b, len(b), []) for b in blobs], OBJECTS)


def test_store(spark, tmp_path):
    url = f"file://{tmp_path}/store"
    with pytest.raises(StoreError):
        Store.open(spark, url)
    store = Store.init(spark, url)
    with pytest.raises(StoreError):
        Store.init(spark, url)
    store.put(objects(spark, b"a", b"b", b"a"))
    store.put(objects(spark, b"b", b"c"))
    assert store.count() == 3 and Store.open(spark, url).uuid == store.uuid
    d = digest_of(b"c", [], "SHA-2-256")
    assert store.load(d) == (b"c", []) and store.search(d[:2]).count() == 1
    with pytest.raises(StoreError):
        store.load(b"no")
    store.swap_branches({}, {"master": d})
    with pytest.raises(StoreError):
        store.swap_branches({}, {"other": d})
    with pytest.raises(StoreError):
        store.swap_branch("x", None, b"\0" * 32)
    store.swap_branch("x", None, d)
    store.swap_branch("master", d, None)
    assert store.load_branches() == {"x": d}


def test_life_of_a_repository(spark, tmp_path):
    a = tmp_path / "a"
    (a / "x" / "y").mkdir(parents=True)
    big = os.urandom(9000)
    (a / "x" / "y" / "f").write_bytes(b"hello")
    (a / "big").write_bytes(big)
    (a / "x" / "odd +% name").write_bytes(b"")
    repo = Repository.init(spark, str(a), parameters=Parameters(1, 256, 6, 1))
    with pytest.raises(RepositoryError):
        repo.commit("nothing")
    repo.stage(".")
    assert {tuple(r["path"]) for r in repo.status()["staged"].collect()} == {("big",), ("x",)}
    first = repo.commit("first", "Ann", seconds=100)
    with pytest.raises(RepositoryError):
        repo.commit("again")
    (a / "x" / "y" / "f").write_bytes(b"changed")
    (a / "x" / "odd +% name").unlink()
    repo.stage("x")
    assert {(r["change"], "/".join(r["path"])) for r in repo.status()["staged"].collect()} == {("modified", "x/y/f"), ("removed", "x/odd +% name")}
    repo.unstage("x/y/f")
    assert [r["change"] for r in repo.status()["staged"].collect()] == ["removed"]
    repo.stage("x")
    repo.commit("second", seconds=200)
    assert [r["message"] for r in repo.log().collect()] == ["second", "first"]
    assert repo.fsck().isEmpty()
    other = Repository.clone(spark, f"file://{a}/.siltstone/store", str(tmp_path / "b"))
    assert (tmp_path / "b" / "big").read_bytes() == big and (tmp_path / "b" / "x" / "y" / "f").read_bytes() == b"changed"
    assert other.checkout("master") == 0
    (tmp_path / "b" / "new").write_bytes(b"n")
    other.stage("new")
    other.commit("third", seconds=300)
    other.push()
    assert Repository.search(spark, str(a / "x")).log().first()["message"] == "third"
    repo.branch_create("old", first)
    repo.checkout("old")
    assert not (a / "new").exists() and (a / "x" / "odd +% name").exists()
    with pytest.raises(RepositoryError):
        repo.checkout("nowhere")


def test_cache_resolves_unchanged_files_only(spark):
    inode = "struct<timestamp_ns: bigint, generation: bigint, number: bigint, version: bigint, ctime_ns: bigint, mtime_ns: bigint>"
    child = "struct<kind: string, digest: binary, size: bigint, depth: smallint>"
    ref = ("small", b"d", 1, 0)
    old, same, late = (9, 0, 1, None, 5, 5), (20, 0, 1, None, 5, 5), (20, 0, 1, None, 19, 19)
    empty = spark.createDataFrame([], f"path string, child {child}, inode {inode}")
    snaps = spark.createDataFrame([("a", ref, old), ("b", ref, old)], f"path string, child {child}, inode {inode}")
    now = spark.createDataFrame([("a", same), ("b", late), ("c", same)], f"path string, inode {inode}")
    cache = index.resolve(empty, snaps, now)
    assert [r["path"] for r in cache.collect()] == ["a"]
    stored = spark.createDataFrame([(b"d",)], "digest binary")
    assert {r["path"] for r in index.to_hash(cache, now, stored).collect()} == {"b", "c"}
    assert {r["path"] for r in index.to_hash(cache, now, stored.where("false")).collect()} == {"a", "b", "c"}


def test_streamed_files_are_stored(spark, tmp_path):
    schema = "stream string, seq long, data binary, last boolean"
    data = os.urandom(4000)
    rows = [("s", i, data[i * 500 : (i + 1) * 500], i == 7) for i in range(8)] + [("t", 0, b"short", True)]
    for part in (rows[:3], rows[3:5], rows[5:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    store = Store.init(spark, f"file://{tmp_path}/store")
    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = store_chunks(chunk_stream(arrivals, Parameters(1, 64, 5, 1)), store, f"{tmp_path}/checkpoint")
    q.awaitTermination(120)
    assert store.count() > 5 and store.objects().where(F.col("blob") == F.lit(b"short")).count() == 1
    assert store.objects().agg(F.sum("blob_len")).first()[0] == 4005


def test_command_line(spark, tmp_path, capsys):
    from siltstone.__main__ import main

    def say(*words):
        code = main(["-C", str(tmp_path), *words])
        out = capsys.readouterr()
        return code, out.out.splitlines(), out.err

    (tmp_path / "f").write_bytes(b"x")
    assert say("status")[0] == 1
    assert say("init")[0] == 0
    assert say("stage", ".")[0] == 0
    assert say("status")[1][1:] == ["added f"]
    code, lines, _ = say("commit", "--message", "m")
    assert code == 0 and len(lines[0]) == 64
    assert say("commit")[2].startswith("siltstone: nothing has changed")
    assert say("log")[1][0].endswith(" m") and say("show")[1][0].endswith(" 1 f")
    assert say("branch", "side")[0] == 0 and [x.split()[1] for x in say("branch")[1]] == ["master", "side"]


def test_chains_are_walked_in_few_rounds(spark, monkeypatch):
    from siltstone.operators import dag

    n, written = 3000, []
    links = spark.range(n).select(F.col("id").alias("parent"), (F.col("id") + 1).alias("child")).union(spark.createDataFrame([(n // 2, 10 * n), (10 * n, 10 * n + 1)], "parent long, child long"))
    plain = dag.write_scratch
    monkeypatch.setattr(dag, "write_scratch", lambda df, name: (written.append(name), plain(df, name))[1])
    got = {r["node"] for r in dag.reachable(links, spark.createDataFrame([(5,)], "node long")).collect()}
    assert got == {*range(5, n + 1), 10 * n, 10 * n + 1} and len(written) < 60
    loop = spark.createDataFrame([(i, (i + 1) % 40) for i in range(40)], "parent long, child long")
    assert dag.reachable(loop, spark.createDataFrame([(3,)], "node long")).count() == 40


def test_many_small_files_are_few_tasks(spark, tmp_path):
    from siltstone.sources import working_tree

    want = {}
    for i in range(600):
        at = tmp_path / f"d{i % 7}" / f"e{i % 3}"
        at.mkdir(parents=True, exist_ok=True)
        (at / f"f{i}").write_bytes(b"%d" % i)
        want[f"d{i % 7}/e{i % 3}/f{i}"] = b"%d" % i
    (tmp_path / "_metadata").write_bytes(b"m")  # Spark's source lists this one although its name begins with _
    (tmp_path / "d1" / "up").symlink_to(tmp_path)
    found = working_tree.scan(spark, f"file://{tmp_path}")
    assert found.rdd.getNumPartitions() <= 2
    got = [("/".join(r["path"]), bytes(r["content"])) for r in found.collect()]
    assert len(got) == 601 and dict(got) == want | {"_metadata": b"m"}


def test_files_that_hold_their_data_stay(spark, tmp_path):
    from siltstone.sources import working_tree

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "same").write_bytes(b"1")
    (tmp_path / "a" / "other").write_bytes(b"2")
    (tmp_path / "in").write_bytes(b"the way")
    before = (tmp_path / "a" / "same").stat().st_ino
    rows = spark.createDataFrame([(["a", "same"], b"1"), (["a", "other"], b"3"), (["in", "x", "new"], b"4")], "path array<string>, data binary")
    assert working_tree.write_files(rows, str(tmp_path)).count() == 3
    assert (tmp_path / "a" / "same").stat().st_ino == before
    assert (tmp_path / "a" / "other").read_bytes() == b"3" and (tmp_path / "in" / "x" / "new").read_bytes() == b"4"
    assert working_tree.delete_files(rows.where("path[0] = 'in'"), str(tmp_path)) == 1
    assert not (tmp_path / "in").exists() and (tmp_path / "a").exists()


def test_tables_of_files_are_not_broadcast(spark):
    """Paths take little room in Parquet files, so Spark takes tables of very many files for small ones."""
    ref, inode = "struct<kind: string, digest: binary, size: bigint, depth: smallint>", "struct<timestamp_ns: bigint, generation: bigint, number: bigint, version: bigint, ctime_ns: bigint, mtime_ns: bigint>"
    row = (["a"], ("small", b"d", 1, 0), (9, 0, 1, None, 1, 1))
    known = write_scratch(spark.createDataFrame([row], f"path array<string>, child {ref}, inode {inode}"), "known")
    ops = known.select(F.lit(1).cast("long").alias("seq"), "path", F.lit("add").alias("op"), "child")
    ranges = write_scratch(spark.createDataFrame([("a", 0, 5, b"d"), ("a", 5, 9, b"e")], "key string, start long, end long, digest binary"), "ranges")
    made = {
        "status": (index.status(known, known).where("status = 'extant'"), 1),
        "resolve": (index.resolve(known, known, known), 1),
        "apply_batch": (batch.apply_batch(known.select("path", "child"), ops), 1),
        "range_delta": (files.range_delta(ranges, ranges.where("start = 0"), ["key"]), 1),
    }
    for name, (rows, n) in made.items():
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString(), name
        assert rows.count() == n, name
