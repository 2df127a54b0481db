import os

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions.digest import digest_of
from siltstone.operators import batch, dag, diff, encode, files, tree
from siltstone.operators.chunk import Parameters

REF = encode.REF


def small(data: bytes):
    return ("small", digest_of(data, [], "SHA-2-256"), len(data), 0)


def flat(spark, entries):
    return spark.createDataFrame([(p.split("/"), r) for p, r in entries.items()], f"path array<string>, child {REF}")


def paths(df):
    return {"/".join(r["path"]): r for r in df.collect()}


@given(st.lists(st.tuples(st.text(max_size=8), st.sampled_from(["small", "large", "tree"]), st.integers(0, 2**20), st.integers(1, 255)), max_size=30, unique_by=lambda x: x[0]))
def test_tree_decodes_any_names(entries):
    entries = sorted(entries, key=lambda e: e[0].encode())
    refs, lines = [], b""
    for name, kind, size, depth in entries:
        d = digest_of(kind.encode(), [], "SHA-2-256")
        if d not in refs:
            refs.append(d)
        body = (f"{refs.index(d)} tree {name}" if kind == "tree" else f"{refs.index(d)} data {size} {depth if kind == 'large' else 0} {name}").encode()
        lines += b"%d:%s,\n" % (len(body), body)
    got = encode.decode_tree(lines, refs)
    assert [(e["name"], e["child"]["kind"]) for e in got] == [(n, k) for n, k, _, _ in entries]


def test_encoders_equal_vectors(spark):
    h, w = small(b"hello"), small(b"world")
    df = spark.createDataFrame([("p", 0, 5, h), ("p", 5, 10, w), ("p", 10, 15, h)], f"parent string, start long, end long, child {REF}")
    row = encode.encode_large(df).first()
    assert bytes(row["blob"]) == b"0 5 0\n5 10 1\n10 15 0\n" and [bytes(x) for x in row["refs"]] == [h[1], w[1]]
    assert [e["end"] for e in encode.decode_large(bytes(row["blob"]), row["refs"], 15, 1)] == [5, 10, 15]
    df = spark.createDataFrame([("p", n, c) for n, c in (("c", w), ("a", h), ("b", h))], f"parent string, name string, child {REF}")
    assert bytes(encode.encode_tree(df).first()["blob"]) == b"12:0 data 5 0 a,\n12:0 data 5 0 b,\n12:1 data 5 0 c,\n"
    with pytest.raises(Exception, match="is empty"):
        encode.encode_large(spark.createDataFrame([("p", 0, 0, h)], f"parent string, start long, end long, child {REF}")).collect()
    with pytest.raises(Exception, match="holds small"):
        encode.encode_tree(spark.createDataFrame([("p", "x", ("commit", h[1], None, None))], f"parent string, name string, child {REF}")).collect()


def test_offsets_of_a_parent_dealt_over_many_tasks(spark):
    sizes = [(i * 7) % 11 if i % 13 else None for i in range(700)]
    rows = [("a", i, n) for i, n in enumerate(sizes)] + [(None, 0, 3), (None, 1, 4), ("b", 5, 0)]
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([rows[(i * 101) % len(rows)] for i in range(len(rows))], "k string, i int, size int")
        found = files.long_offsets(df, "k", "i").withColumn("task", F.spark_partition_id()).collect()
        assert files.long_offsets(df.where("false"), "k", "i").collect() == []
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert len({r["task"] for r in found if r["k"] == "a"}) > 3  # a window over the parent would be one task
    ends = [sum(n or 0 for n in sizes[: i + 1]) for i in range(700)]
    want = {("a", i): (i, e - (n or 0), e) for i, (n, e) in enumerate(zip(sizes, ends, strict=True))} | {(None, 0): (0, 0, 3), (None, 1): (1, 3, 7), ("b", 5): (0, 0, 0)}
    assert {(r["k"], r["i"]): (r["place"], r["start"], r["end"]) for r in found} == want


def test_large_objects_of_empty_entries(spark):
    """Entries without bytes have their places, at every level, if an order tells them."""
    data = [b"" if i % 3 else b"%d" % i for i in range(60)]
    ends = [sum(map(len, data[: i + 1])) for i in range(60)]
    rows = [(k, i, e - len(d), e, small(d), small(d)[1][0]) for k in ("f", None) for i, (d, e) in enumerate(zip(data, ends, strict=True))]
    df = spark.createDataFrame(rows, f"k string, place int, start long, end long, child {REF}, signature int")
    refs, objects = files.hierarchy(df, "k", 16, order="place", minimum=4, log2_modulus=3)
    stored = {bytes(r["digest"]): r for r in objects.collect()}

    def leaves(child):
        if child["kind"] == "small":
            return [bytes(child["digest"])]
        o = stored[bytes(child["digest"])]
        return [x for e in encode.decode_large(bytes(o["blob"]), list(o["refs"]), child["size"], child["depth"]) for x in leaves(e["child"])]

    found = {r["k"]: r["child"] for r in refs.collect()}
    assert found.keys() == {"f", None} and all(c["depth"] > 1 and c["size"] == ends[-1] for c in found.values())
    assert all(leaves(c.asDict()) == [small(d)[1] for d in data] for c in found.values())


@given(st.lists(st.binary(min_size=32, max_size=32), max_size=4), st.one_of(st.none(), st.text(max_size=30)), st.one_of(st.none(), st.text(max_size=30)), st.one_of(st.none(), st.text(max_size=60)), st.integers(0, 2**32), st.integers(-23 * 60, 22 * 60))
def test_commits_round_trip(parents, name, mbox, message, seconds, minutes):
    commit = {"subtree": b"\7" * 32, "parents": parents, "seconds": seconds, "offset_s": minutes * 60, "name": name, "mbox": mbox, "message": message}
    assert encode.decode_commit(*encode.encode_commit(commit)) == commit


def test_share_and_reassemble(spark):
    data = {"empty": b"", "one": b"abc", "many": os.urandom(5000), "again": b"abc"}
    df = spark.createDataFrame(list(data.items()), "key string, data binary")
    refs, objects = files.share(df, "key", "data", Parameters(1, 64, 5, 1))
    kinds = {r["key"]: r["child"] for r in refs.collect()}
    assert kinds["empty"]["kind"] == kinds["one"]["kind"] == "small" and kinds["many"]["kind"] == "large"
    assert kinds["one"]["digest"] == kinds["again"]["digest"] and kinds["many"]["size"] == 5000
    stored = objects.dropDuplicates(["digest"])
    big = refs.where("child.kind = 'large'").select("key", "child.*").join(stored, "digest")
    entries = encode.decoded_larges(big, ["key"])
    assert bytes(files.reassembled(entries, stored, "key").first()["data"]) == data["many"]
    lo = entries.orderBy("start").collect()[1]
    part = files.overlapping(entries, lo["start"] + 1, lo["start"] + 2).collect()
    assert [r["start"] for r in part] == [lo["start"]]


def test_trees_flatten_to_what_they_were_built_of(spark):
    leaves = {"a/b/c": small(b"1"), "a/b/d": small(b"2"), "a/e": small(b"1"), "f\n g": small(b"")}
    root, objects = tree.build_tree(flat(spark, leaves))
    got = paths(tree.flatten(objects, bytes(root.first()["child"]["digest"])))
    assert tree.flatten(objects.unionByName(objects), bytes(root.first()["child"]["digest"])).count() == len(got)
    assert {p for p, r in got.items() if r["child"]["kind"] == "tree"} == {"a", "a/b"}
    assert {p: bytes(r["child"]["digest"]) for p, r in got.items() if r["child"]["kind"] == "small"} == {p: c[1] for p, c in leaves.items()}
    assert [r["name"] for r in tree.listing(objects, bytes(root.first()["child"]["digest"]), ["a"]).orderBy("name").collect()] == ["b", "e"]
    empty, _ = tree.build_tree(flat(spark, leaves).where("false"))
    assert bytes(empty.first()["child"]["digest"]) == digest_of(b"", [], "SHA-2-256")


def with_dirs(spark, leaves):
    root, objects = tree.build_tree(flat(spark, leaves))
    return tree.flatten(objects, bytes(root.first()["child"]["digest"]))


def stored(spark, leaves):
    root, objects = tree.build_tree(flat(spark, leaves))
    return bytes(root.first()["child"]["digest"]), objects


def test_stored_changes_are_those_of_flat_trees(spark):
    one, two = small(b"1"), small(b"2")
    sides = [{"same/a/b": one, "mod": one, "gone/x/y": one, "d/k": one, "was_dir/p/q": one, "was_file": one, "deep/1/2/3": one}, {"same/a/b": one, "mod": two, "new/x/y": one, "d/k": one, "d/n": one, "was_dir": one, "was_file/q/r": one, "deep/1/2/3": two}]
    (a, of_a), (b, of_b) = (stored(spark, s) for s in sides)
    objects = of_a.unionByName(of_b)  # trees both have are there twice
    want = sorted((r["change"], r["path"]) for r in diff.changes(*(with_dirs(spark, s) for s in sides)).collect())
    assert sorted((r["change"], r["path"]) for r in diff.stored_changes(objects, a, b).collect()) == want
    assert diff.stored_changes(objects, a, a).isEmpty()
    same = bytes(tree.listing(objects, a, []).where("name = 'same'").first()["digest"])
    assert sorted((r["change"], r["path"]) for r in diff.stored_changes(objects.where(F.col("digest") != F.lit(same)), a, b).collect()) == want  # never read


def test_places_are_numbered_over_ranges(spark):
    values = [(i * 37 % 101, i % 5) for i in range(101)]
    df = spark.createDataFrame(values, "a int, b int")
    got = {r["place"]: (r["a"], r["b"]) for r in dag.numbered(df, "place", F.desc("b"), F.col("a")).collect()}
    want = sorted(values, key=lambda v: (-v[1], v[0]))
    assert got == dict(enumerate(want, 1))
    assert dag.numbered(df.where("false"), "place", F.col("a"), F.col("b")).collect() == []


def test_listing_and_wanted_paths(spark):
    one = small(b"1")
    root, objects = stored(spark, {"d/k": one, "d/e/f": one, "x": one, "y/z": one})
    names = lambda path: sorted((r["name"], r["kind"]) for r in tree.listing(objects, root, path).collect())
    assert names([]) == [("d", "tree"), ("x", "small"), ("y", "tree")]
    assert names(["d"]) == [("e", "tree"), ("k", "small")]
    assert names(["d", "e"]) == [("f", "small")]
    assert names(["x"]) == names(["no"]) == names(["x", "no"]) == []
    wanted = spark.createDataFrame([(["d", "e", "f"],), (["x"],), (["x", "no"],), (["y"],), (["no", "no"],)], "path array<string>")
    found = {"/".join(r["path"]): r["child"] for r in tree.look_up(tree.flatten(objects, root, wanted), wanted).collect()}
    assert {p for p, child in found.items() if child} == {"d/e/f", "x", "y"} and len(found) == 5


def test_changes(spark):
    one, two = small(b"1"), small(b"2")
    head = with_dirs(spark, {"same": one, "mod": one, "gone/x/y": one, "d/k": one, "was_dir/p": one, "was_file": one})
    cand = with_dirs(spark, {"same": one, "mod": two, "new/x/y": one, "d/k": one, "d/n": one, "was_dir": one, "was_file/q/r": one})
    got = {(r["change"], "/".join(r["path"])) for r in diff.changes(head, cand).collect()}
    assert got == {("modified", "mod"), ("removed", "gone"), ("added", "new"), ("added", "d/n"), ("added", "was_dir"), ("removed", "was_dir/p"), ("removed", "was_file"), ("added", "was_file/q")}
    assert diff.changes(head, head).isEmpty()
    assert {"/".join(r["path"]) for r in diff.initial_changes(head).collect()} == {"same", "mod", "gone", "d", "was_dir", "was_file"}
    leaf = {(r["change"], "/".join(r["path"])) for r in diff.leaf_diff(head, cand).collect()}
    assert ("removed", "gone/x/y") in leaf and ("added", "new/x/y") in leaf


def apply_in_order(leaves, ops):
    now = dict(leaves)
    for _, path, op, child in sorted(ops, key=lambda o: o[0]):
        now = {p: c for p, c in now.items() if p != path and not p.startswith(path + "/") and not (op == "add" and path.startswith(p + "/"))}
        if op == "add":
            now[path] = child
    return now


def test_batches_equal_one_by_one(spark):
    import random

    rng = random.Random(4)
    names = ["a", "a/b", "a/b/c", "a/d", "e", "e/f", "g"]
    for _ in range(4):
        leaves = apply_in_order({}, [(i, rng.choice(names), "add", small(bytes([i]))) for i in range(4)])
        ops = [(i, rng.choice(names), rng.choice(["add", "delete"]), small(bytes([i + 50]))) for i in range(6)]
        df = spark.createDataFrame([(i, p.split("/"), op, c if op == "add" else None) for i, p, op, c in ops], f"seq long, path array<string>, op string, child {REF}")
        got = {p: tuple(r["child"]) for p, r in paths(batch.apply_batch(flat(spark, leaves) if leaves else spark.createDataFrame([], f"path array<string>, child {REF}"), df)).items()}
        assert {p: bytes(c[1]) for p, c in got.items()} == {p: c[1] for p, c in apply_in_order(leaves, ops).items()}


def test_batch_needs_paths(spark):
    ops = spark.createDataFrame([(0, [], "delete", None)], f"seq long, path array<string>, op string, child {REF}")
    with pytest.raises(Exception, match="needs a path"):
        batch.apply_batch(flat(spark, {"a": small(b"")}), ops).collect()


def test_integrity(spark):
    leaves = {"a/b": small(b"1"), "a/c": small(b"2"), "d": small(b"1")}
    root, trees = tree.build_tree(flat(spark, leaves))
    none = F.array().cast("array<binary>")
    blobs = spark.createDataFrame([(digest_of(x, [], "SHA-2-256"), x) for x in (b"1", b"2")], "digest binary, blob binary").withColumn("refs", none)
    objects = blobs.unionByName(trees.select("digest", "blob", "refs"))
    assert dag.check_integrity(objects).isEmpty() and dag.check_each(objects).isEmpty()
    bad = objects.withColumn("blob", F.when(F.col("blob") == F.lit(b"2"), F.lit(b"x")).otherwise(F.col("blob")))
    assert dag.check_each(bad).count() == 1
    assert dag.check_integrity(bad).count() == 3  # the leaf, its directory, the root
    lacking = objects.where(F.col("blob") != F.lit(b"2"))
    assert dag.check_integrity(lacking).where("calculated is null").count() == 2


def test_history_meets_each_commit_once(spark):
    rows = [(bytes([i]), [bytes([j]) for j in (i - 1, i - 2) if j >= 0], 100 - abs(i - 5), f"c{i}") for i in range(12)] + [(b"z", [], 1, "apart")]
    commits = spark.createDataFrame(rows, "digest binary, parents array<binary>, seconds long, message string")
    got = [(r["seconds"], bytes(r["digest"])) for r in dag.history(commits, bytes([9])).collect()]
    assert got == sorted(((r[2], r[0]) for r in rows[:10]), key=lambda x: (-x[0], x[1]))
