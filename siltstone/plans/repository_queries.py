"""Queries over stores, versioned working directories and the older formats' operators; importing this completes ``QUERIES``.

Working directories are made in the shared folder (which must be mounted, as a
working directory is): snapshot A is committed first, then B.
"""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import digest, text
from siltstone.operators import chunk, dag, diff, encode, files, index, references, tree
from siltstone.operators.chunk import Parameters
from siltstone.plans import oracle as O
from siltstone.plans import queries as q
from siltstone.plans.queries import ORACLES, QUERIES, query
from siltstone.plans.repository import Repository, RepositoryError
from siltstone.sources import working_tree
from siltstone.sources.store import OBJECTS, ReadThrough, Store, StoreError, open_store
from siltstone.sources.tables import Files, new_path, unsent, write_scratch
from siltstone.streaming import ingest

__all__ = ["ORACLES", "QUERIES"]

#: No document is cut, so that every file is one small object.
WHOLE = Parameters(1, 1 << 26)
NOTE = 'the "second" commit,\nwith \'quotes\', a\ttab and é\\'


def _objects(snapshot: DataFrame) -> DataFrame:
    blob = F.col("blob")
    return snapshot.select(digest.object_digest(blob).alias("digest"), F.lit(digest.NATIVE).alias("hash_name"), "blob", F.octet_length(blob).cast("long").alias("blob_len"), F.array().cast("array<binary>").alias("refs"))


def _folder(spark: SparkSession, name: str) -> str:
    return urlparse(new_path(spark, name)).path


def _fill(snapshot: DataFrame, base: str) -> None:
    """Make a directory hold a snapshot's documents as files, and no others."""
    rows = snapshot.select(F.array("lang", "source", F.concat(F.lit("doc_"), "id")).alias("path"), F.coalesce("blob", F.lit(b"")).alias("data"))
    rows = write_scratch(rows, "files")
    there = working_tree.scan(snapshot.sparkSession, f"file://{base}", [".siltstone/**"], with_content=False)
    working_tree.delete_files(there.join(unsent(rows.select("path")), "path", "left_anti"), base)
    working_tree.write_files(rows, base).count()


def _copy(repo: Repository, base: str) -> None:
    """Copy a repository with its working directory, files in tasks; the copies of files that its cache knows are known."""
    made = repo.base

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path in f["path"]:
                try:
                    shutil.copyfile(os.path.join(made, *path), os.path.join(base, *path))
                except FileNotFoundError:
                    shutil.copyfile(os.path.join(made, *path), working_tree.clear_way(base, list(path)))
            yield f

    shutil.copytree(f"{made}/.siltstone", f"{base}/.siltstone")
    config = Files(repo.spark, f"file://{base}/.siltstone")
    config.write_json("CONFIG.json", json.loads(json.dumps(config.read_json("CONFIG.json")).replace(made, base)))
    there = working_tree.snapshots(working_tree.scan(repo.spark, f"file://{made}", with_content=False), made)
    known = index.status(repo.cache(), there).where("inode is not null").select("path", F.when(F.col("unchanged"), F.col("child")).alias("child"))
    copied = write_scratch(known.mapInPandas(run, known.schema), "copied").where("child is not null")
    copy = Repository.open(repo.spark, base, parameters=WHOLE)
    copy._save_cache(working_tree.snapshots(copied, base).join(unsent(copied), "path"))


_MADE: dict[tuple, tuple[str, list[bytes]]] = {}


def _repository(spark: SparkSession, sf: str, second: bool = False) -> tuple[Repository, list[bytes]]:
    """A repository with snapshot A committed, and B if wanted; its commits. Made once for an application, then copied."""
    key = (spark.sparkContext.applicationId, sf, second)
    if key not in _MADE:
        if second:
            repo, commits = _repository(spark, sf)
        else:
            repo, commits = Repository.init(spark, _folder(spark, "work"), parameters=WHOLE), []
        _fill((q._snapshot_b if second else q._blobs)(spark, sf), repo.base)
        repo.stage(".")
        commits = [*commits, repo.commit(NOTE if second else "first", "Ann", seconds=2000 if second else 1000, offset_s=3600)]
        _MADE[key] = repo.base, commits
    made, commits = _MADE[key]
    base = _folder(spark, "work")
    _copy(Repository.open(spark, made, parameters=WHOLE), base)
    return Repository.open(spark, base, parameters=WHOLE), list(commits)


def _contents(spark: SparkSession, base: str) -> DataFrame:
    found = working_tree.scan(spark, f"file://{base}", [".siltstone/**"])
    return found.select(q._path(), "length", F.sha2("content", 256).alias("sha"))


FILES = "SELECT lang || '/' || source || '/doc_' || id AS path, octet_length(blob)::BIGINT AS length, sha256(blob) AS sha FROM ({})"


# --- stores


@query(f"WITH {q.TWO}, both_ AS (SELECT blob FROM a UNION ALL SELECT blob FROM b) SELECT DISTINCT {O.digest('blob')} AS digest, octet_length(blob)::BIGINT AS blob_len, sha256(blob) AS sha FROM both_ WHERE {O.digest('blob')} IN (SELECT digest FROM db)")
def store_read(spark: SparkSession, sf: str) -> DataFrame:
    """The objects of B, read from a store that was made, written twice, compacted and opened again."""
    store = Store.init(spark, new_path(spark, "store"))
    b = _objects(q._snapshot_b(spark, sf))
    store.put(_objects(q._blobs(spark, sf)))
    store.put(b)
    store.put(b)
    store.compact()
    again = open_store(spark, store.path)
    if again.uuid != store.uuid:
        raise StoreError("another store was opened")
    first = again.objects().orderBy("digest").first()
    if first is not None and again.load(bytes(first["digest"]))[0] != bytes(first["blob"]):
        raise StoreError("a single read gives another object")
    return again.get(b).select(q._hex().alias("digest"), "blob_len", F.sha2("blob", 256).alias("sha"))


@query(f"WITH {q.TWO}, oa AS (SELECT DISTINCT * FROM da), ob AS (SELECT DISTINCT * FROM db), fresh AS (SELECT * FROM ob WHERE digest NOT IN (SELECT digest FROM oa)) SELECT 1::INTEGER AS step, (SELECT count(*) FROM oa) AS offered, (SELECT count(*) FROM oa) AS fresh, (SELECT coalesce(sum(size), 0)::BIGINT FROM oa) AS bytes UNION ALL SELECT 2, (SELECT count(*) FROM ob), count(*), coalesce(sum(size), 0)::BIGINT FROM fresh UNION ALL SELECT 3, (SELECT count(*) FROM ob), 0, 0")
def put_progress(spark: SparkSession, sf: str) -> DataFrame:
    """What each put tells: objects offered, fresh ones, and their bytes."""
    store = Store.init(spark, new_path(spark, "store"))
    a, b = _objects(q._blobs(spark, sf)), _objects(q._snapshot_b(spark, sf))
    told = [store.put(x) for x in (a, b, b)]
    return spark.createDataFrame([(i + 1, t["offered"], t["fresh"], t["bytes"]) for i, t in enumerate(told)], "step int, offered long, fresh long, bytes long")


@query(f"WITH {q.TWO} SELECT 'asked' AS which, digest, size FROM (SELECT DISTINCT * FROM db) UNION ALL SELECT 'here', digest, size FROM (SELECT * FROM da UNION SELECT * FROM db)")
def read_through(spark: SparkSession, sf: str) -> DataFrame:
    """A store of A that is asked for B's objects fills itself from a store of B."""
    local, remote = (Store.init(spark, new_path(spark, "store")) for _ in range(2))
    b = _objects(q._snapshot_b(spark, sf))
    local.put(_objects(q._blobs(spark, sf)))
    remote.put(b)
    cache = ReadThrough.over(local, remote)
    asked = write_scratch(cache.get(b).select(F.lit("asked").alias("which"), "digest", F.col("blob_len").alias("size")), "asked")
    return asked.unionByName(local.objects().select(F.lit("here").alias("which"), "digest", F.col("blob_len").alias("size"))).select("which", q._hex().alias("digest"), "size")


@query(f"WITH {q.TREES} SELECT y.path, y.kind, y.digest FROM y_tree y WHERE y.kind = 'small' AND y.digest IN (SELECT digest FROM x_tree) UNION ALL SELECT y.path, y.kind, y.digest FROM y_tree y WHERE y.kind = 'tree' AND y.digest IN (SELECT digest FROM x_tree WHERE kind = 'tree')")
def resolve_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    """The references of B, kind by kind, that a store of A can resolve."""
    store = Store.init(spark, new_path(spark, "store"))
    _, _, trees = q._flat(q._blobs(spark, sf))
    store.put(_objects(q._blobs(spark, sf)))
    store.put(trees)
    flat_b = q._flat(q._snapshot_b(spark, sf))[0]
    found = store.resolve_typed(flat_b, "small").unionByName(store.resolve_typed(flat_b, "tree"))
    return store.digests_of(found).select(q._path(), "child.kind", q._hex().alias("digest"))


@query(f"WITH n AS (SELECT n_name AS name, {O.digest('encode(n_name)')} AS digest, octet_length(encode(n_name))::BIGINT AS size FROM nation) SELECT name, 'small' AS kind, digest, size, 0::INTEGER AS depth, sha256(encode(name)) AS sha FROM n")
def typed_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Small objects, a tree of them and a commit of that: written, and read back by their references, one by one."""
    store = Store.init(spark, new_path(spark, "store"))
    names = [r["n_name"] for r in spark.read.parquet(f"{sf}/nation.parquet").select("n_name").orderBy("n_name").collect()]  # 25 rows
    store.put(_objects(spark.createDataFrame([(n.encode(),) for n in names], "blob binary")))
    entries = [{"name": n, "child": {"kind": "small", "digest": digest.digest_of(n.encode(), [], store.hash_name), "size": len(n.encode()), "depth": 0}} for n in names]
    top = store.send("tree", entries)
    parts, at = [], 0
    for e in entries:
        parts.append({"start": at, "end": at + e["child"]["size"], "child": e["child"]})
        at = parts[-1]["end"]
    large = store.send("large", parts)
    if store.fetch(large) != parts:
        raise StoreError("a large object is read back otherwise")
    fields = {"subtree": top["digest"], "parents": [], "seconds": 5, "offset_s": 0, "name": "Ann", "mbox": None, "message": "m"}
    found = store.fetch({"kind": "tree", "digest": store.fetch(store.send("commit", fields))["subtree"]})
    listed = spark.createDataFrame([(e["name"], e["child"]) for e in found], f"name string, child {encode.REF}")
    data = listed.join(store.get(listed.select("child.digest")).withColumnRenamed("digest", "_d"), F.col("child.digest") == F.col("_d"))
    return data.select("name", "child.kind", q._hex("child.digest").alias("digest"), "child.size", F.col("child.depth").cast("int").alias("depth"), F.sha2("blob", 256).alias("sha"))


@query(f"WITH n AS (SELECT n_name, n_nationkey, n_regionkey, {O.digest('encode(n_name)')} AS d FROM nation) SELECT n_name AS branch, d AS digest, false AS failed FROM n WHERE n_regionkey <> 1 AND n_nationkey <> (SELECT max(n_nationkey) FROM nation WHERE n_regionkey <> 1) UNION ALL SELECT 'extra', d, false FROM n WHERE n_nationkey = (SELECT min(n_nationkey) FROM nation) UNION ALL SELECT 'swap of a map that has changed', NULL, true UNION ALL SELECT 'swap of a branch that has changed', NULL, true UNION ALL SELECT 'branch to an object that is not stored', NULL, true")
def branch_swaps(spark: SparkSession, sf: str) -> DataFrame:
    """Whole maps and single branches compared and swapped; swaps that must fail are told."""
    store = Store.init(spark, new_path(spark, "store"))
    n = spark.read.parquet(f"{sf}/nation.parquet")
    store.put(_objects(n.select(F.col("n_name").cast("binary").alias("blob"))))
    rows = n.select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()  # 25 rows
    of = {r["n_name"]: digest.digest_of(r["n_name"].encode(), [], store.hash_name) for r in rows}
    store.swap_branches({}, of)
    kept = [r["n_name"] for r in rows if r["n_regionkey"] != 1]
    store.swap_branches(of, {k: of[k] for k in kept})
    store.swap_branch("extra", None, of[rows[0]["n_name"]])
    store.swap_branch(kept[-1], of[kept[-1]], None)
    failed = []
    for what, swap in (
        ("swap of a map that has changed", lambda: store.swap_branches(of, {})),
        ("swap of a branch that has changed", lambda: store.swap_branch("extra", None, of[kept[0]])),
        ("branch to an object that is not stored", lambda: store.swap_branch("new", None, b"\0" * 32)),
    ):
        try:
            swap()
        except StoreError:
            failed.append((what,))
    told = spark.createDataFrame(failed, "branch string").select("branch", F.lit(None).cast("string").alias("digest"), F.lit(True).alias("failed"))
    return store.branches().select("branch", q._hex().alias("digest"), F.lit(False).alias("failed")).unionByName(told)


@query("SELECT 'same' AS pair, true AS equal UNION ALL SELECT 'merged', (SELECT count(*) FROM nation WHERE n_regionkey = 2) = 0")
def branch_maps_equal(spark: SparkSession, sf: str) -> DataFrame:
    """The precondition of a swap: whether two whole maps are equal."""
    local, _ = q._branches(spark, sf)
    merged = q.branch_merge_right(spark, sf)
    return spark.createDataFrame([("same", references.same_map(local, local.select("*"))), ("merged", references.same_map(local, merged))], "pair string, equal boolean")


@query("SELECT 'local' AS kind, NULL AS remote, n_name AS branch, n_nationkey::BIGINT AS digest FROM nation UNION ALL SELECT 'remote', r_name, n_name, (n_nationkey + 100)::BIGINT FROM nation JOIN region ON n_regionkey = r_regionkey")
def resolve_required(spark: SparkSession, sf: str) -> DataFrame:
    """References of which each must exist."""
    branches = references.all_branches(*q._branches(spark, sf)).withColumn("digest", F.col("digest").cast("string").cast("binary"))
    found = references.resolved(branches.select("kind", "remote", "branch"), branches, None, required=True)
    return found.withColumn("digest", F.col("digest").cast("string").cast("long"))


# --- working directories


@query(f"WITH {q.TREES} {q.CHANGES}")
def repo_status(spark: SparkSession, sf: str) -> DataFrame:
    """What is staged after A was committed and the files were made those of B."""
    repo, _ = _repository(spark, sf)
    _fill(q._snapshot_b(spark, sf), repo.base)
    repo.stage(".")
    found = Repository.search(spark, f"{repo.base}/en", parameters=WHOLE).status()
    if found["head"] != "master" or not found["candidate"]:
        raise RepositoryError("the status names another head or no candidate")
    return found["staged"].select("change", q._path())


@query(f"WITH {q.TREES}, undone AS (SELECT * FROM ({q.CHANGES}) WHERE split_part(path, '/', 2) <> 'src3') SELECT * FROM undone")
def repo_unstage(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the directories src3 put back to what HEAD has."""
    repo, _ = _repository(spark, sf)
    _fill(q._snapshot_b(spark, sf), repo.base)
    repo.stage(".")
    langs = [r["lang"] for r in q._docs(spark, sf).where("source = 'src3'").select("lang").distinct().collect()]  # the few languages
    repo.unstage(*(f"{lang}/src3" for lang in langs))
    return repo.status()["staged"].select("change", q._path())


_NOTE = "'the \"second\" commit,' || chr(10) || 'with ''quotes'', a' || chr(9) || 'tab and é\\'"


@query(f"WITH {q.TREES}, ra AS (SELECT digest FROM x_root), rb AS (SELECT digest FROM y_root) SELECT 1 AS place, {_NOTE} AS message, 'Bob' AS author, 2000::BIGINT AS seconds, 3600 AS offset_s, 1 AS parents, digest AS subtree FROM rb UNION ALL SELECT 2, 'first', 'Ann', 1000, 3600, 0, digest FROM ra")
def repo_log(spark: SparkSession, sf: str) -> DataFrame:
    """Two commits, the second one amended by another author."""
    repo, _ = _repository(spark, sf, second=True)
    for message, force in (("nothing is staged that is new", False),):
        try:
            repo.commit(message, force=force)
            raise AssertionError("a commit without changes was made")
        except RepositoryError:
            pass
    repo.commit(author="Bob", amend=True)
    rows = repo.log().collect()  # two commits
    return spark.createDataFrame([(i + 1, r["message"], r["name"], r["seconds"], r["offset_s"], len(r["parents"]), bytes(r["subtree"]).hex()) for i, r in enumerate(rows)], "place int, message string, author string, seconds long, offset_s int, parents int, subtree string")


@query(f"WITH {q.TREE_A} SELECT name, kind, size, digest FROM tree WHERE parent = 'en'")
def repo_show(spark: SparkSession, sf: str) -> DataFrame:
    """A directory of the commit before, by a branch that leads there."""
    repo, commits = _repository(spark, sf, second=True)
    repo.branch_create("old", commits[0])
    return repo.show("en", "old").select("name", "kind", "size", q._hex().alias("digest"))


@query(FILES.format(O.SNAPSHOT_A))
def repo_checkout(spark: SparkSession, sf: str) -> DataFrame:
    """The files after the commit before was checked out over B."""
    repo, commits = _repository(spark, sf, second=True)
    repo.branch_create("old", commits[0])
    repo.checkout("old")
    return _contents(spark, repo.base)


@query(f"SELECT * FROM ({FILES.format(O.SNAPSHOT_A)}) WHERE split_part(path, '/', 1) <> 'en' UNION ALL SELECT * FROM ({FILES.format(O.SNAPSHOT_B)}) WHERE split_part(path, '/', 1) = 'en'")
def repo_checkout_paths(spark: SparkSession, sf: str) -> DataFrame:
    """A's files, with one directory checked out from the later commit."""
    repo, commits = _repository(spark, sf, second=True)
    repo.branch_create("old", commits[0])
    repo.checkout("old")
    repo.checkout("master", ["en"])
    return _contents(spark, repo.base)


@query(FILES.format(O.SNAPSHOT_B))
def repo_large_checkout(spark: SparkSession, sf: str) -> DataFrame:
    """Files of many chunks, of which a checkout rewrites the ranges that differ."""
    base = _folder(spark, "work")
    repo = Repository.init(spark, base, parameters=q.SMALL)
    for snapshot, branch in ((q._blobs, "old"), (q._snapshot_b, "new")):
        _fill(snapshot(spark, sf), base)
        repo.stage(".")
        repo.branch_create(branch, repo.commit(branch, seconds=1))
    repo.checkout("old")
    repo.checkout("new")
    return _contents(spark, base)


@query(FILES.format(O.SNAPSHOT_B))
def repo_clone_push_pull(spark: SparkSession, sf: str) -> DataFrame:
    """The files of a second clone, after a first one pushed B and the second one pulled it."""
    repo, _ = _repository(spark, sf)
    one, two = (Repository.clone(spark, repo.store.path, _folder(spark, "clone"), parameters=WHOLE) for _ in range(2))
    _fill(q._snapshot_b(spark, sf), one.base)
    one.stage(".")
    pushed = one.commit("B", seconds=3000)
    one.push()
    two.pull()
    if two.resolve("origin/master") != pushed or [r["remote"] for r in two.remotes().collect()] != ["origin"]:
        raise RepositoryError("the clone has another remote branch")
    return _contents(spark, two.base)


@query("SELECT * FROM (VALUES ('local', NULL, 'kept', 'first', NULL), ('local', NULL, 'master', 'second', 'origin/master'), ('local', NULL, 'moved', 'second', NULL), ('remote', 'origin', 'master', 'second', NULL), ('remote', 'origin', 'side', 'first', NULL)) AS t(kind, remote, branch, message, upstream)")
def repo_branches(spark: SparkSession, sf: str) -> DataFrame:
    """Branches made in each mode, deleted and tracked, beside those of a remote; with the commits they lead to."""
    base = _folder(spark, "work")
    repo = Repository.init(spark, base, parameters=WHOLE)
    _fill(spark.createDataFrame([(1, "en", "s", b"x")], "id int, lang string, source string, blob binary"), base)
    repo.stage(".")
    first = repo.commit("first", seconds=1)
    repo.branch_create("side")
    _fill(spark.createDataFrame([(1, "en", "s", b"y")], "id int, lang string, source string, blob binary"), base)
    repo.stage(".")
    second = repo.commit("second", seconds=2)
    two = Repository.clone(spark, repo.store.path, _folder(spark, "clone"), parameters=WHOLE)
    for name in ("kept", "moved", "gone"):
        two.branch_create(name, first)
    two.branch_create("kept", second, mode="nothing")
    two.branch_create("moved", second, mode="overwrite")
    try:
        two.branch_create("gone", second)
        raise AssertionError("a branch was replaced")
    except RepositoryError:
        two.branch_delete("gone")
    two.set_upstream("kept", "origin", "side")
    two.set_upstream("kept", None)
    up = spark.createDataFrame([(b, f"{u['remote']}/{u['branch']}") for b, u in two.state()["upstreams"].items()], "branch string, upstream string").withColumn("kind", F.lit("local"))
    log = two.log().select("digest", "message")
    return two.branches().join(log, "digest").join(up, ["kind", "branch"], "left").select("kind", "remote", "branch", "message", "upstream")


@query(f"WITH {q.TREE_A} SELECT digest AS stored FROM root WHERE false")
def repo_fsck(spark: SparkSession, sf: str) -> DataFrame:
    """Nothing is wrong from HEAD on, under the store's own hash."""
    repo, _ = _repository(spark, sf, second=True)
    return repo.fsck(hash_name=digest.NATIVE).select(q._hex("stored").alias("stored"))


@query("SELECT * FROM (VALUES ('_set/in'), ('_x.py'), ('a/_y'), ('a/empty'), ('a/keep.log'), ('a/plain')) AS t(path)")
def scan_ignores(spark: SparkSession, sf: str) -> DataFrame:
    """Hidden files, and those that ignore files name, are not scanned; names that begin with an underscore are."""
    base = _folder(spark, "work")
    wanted = {"_set/in": b"1", "_x.py": b"2", "a/_y": b"3", "a/empty": b"", "a/keep.log": b"4", "a/plain": b"5", ".hidden": b"6", "a/.b/c": b"7", "a/x.log": b"8", "build/out": b"9", "a/top": b"10", "top": b"11", ".gitignore": b"# built\n*.log\nbuild/\n/top\n!keep.log\n", "a/.ignore": b"/top\n"}
    os.makedirs(base)
    working_tree.write_files(spark.createDataFrame([(p.split("/"), d) for p, d in wanted.items()], "path array<string>, data binary"), base).count()
    found = working_tree.scan(spark, f"file://{base}")
    whole = found.select(q._path(), "content").collect()  # six files
    if any(bytes(r["content"]) != wanted[r["path"]] for r in whole):
        raise AssertionError("a file was read otherwise")
    return found.select(q._path())


# --- objects and encodings


@query("""SELECT DISTINCT 'added' AS change, lang || '/src3' AS path FROM documents WHERE source = 'src3' UNION ALL SELECT 'removed', lang || '/src3/doc_' || doc_id FROM documents WHERE source = 'src3'
UNION ALL SELECT 'removed', lang || '/src4/doc_' || doc_id FROM documents WHERE source = 'src4' UNION ALL SELECT 'added', lang || '/src4/doc_' || doc_id || '/part' FROM documents WHERE source = 'src4'""")
def status_kind_change(spark: SparkSession, sf: str) -> DataFrame:
    """Directories that became files (src3), and files that became directories (src4)."""
    a = q._leaves(q._blobs(spark, sf))
    file = a.where("path[1] = 'src3'").groupBy(F.slice("path", 1, 2).alias("path")).agg(F.min("child").alias("child"))
    deeper = a.where("path[1] = 'src4'").select(F.array_append("path", F.lit("part")).alias("path"), "child")
    b = a.where("path[1] not in ('src3', 'src4')").unionByName(file).unionByName(deeper)
    (head, of_head), (candidate, of_candidate) = q._built(a), q._built(b)
    return diff.stored_changes(of_head.unionByName(of_candidate).dropDuplicates(["digest"]), head, candidate).select("change", q._path())


@query(f"WITH {q.DAMAGED} SELECT digest AS stored, 3 AS depth FROM bad")
def fsck_local_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Objects at most three references below the root whose own content is wrong; directories above are not to blame."""
    root, _ = tree.build_tree(q._leaves(q._blobs(spark, sf)))
    found = dag.check_to_depth(q._stored(spark, sf, True), root.select(F.col("child.digest").alias("node")), 3)
    return found.select(q._hex("stored").alias("stored"), "depth")


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS message, c_custkey * 86400 AS seconds, 5400 AS offset_s, CASE WHEN c_custkey > 1 THEN 1 ELSE 0 END AS parents FROM customer")
def commit_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Commits that were encoded, decoded again."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [encode.encode_commit({"subtree": b"\0" * 32, "parents": [b"\1" * 32] if r.c_custkey > 1 else [], "seconds": r.c_custkey * 86400, "offset_s": 5400, "name": r.c_name, "mbox": "a@b", "message": r.c_mktsegment}) for r in f.itertuples(index=False)]
            yield pd.DataFrame({"c_custkey": f["c_custkey"], "blob": [b for b, _ in made], "refs": [r for _, r in made]})

    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment").mapInPandas(run, "c_custkey long, blob binary, refs array<binary>")
    return encode.decoded_commits(c, ["c_custkey"]).select("c_custkey", "name", "message", "seconds", "offset_s", F.size("parents").alias("parents"))


@query("SELECT doc_id, sha256(encode(text)) AS sha, octet_length(encode(replace(replace(replace(replace(replace(replace(text, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r'), chr(34), '\\\"'), chr(39), '\\'''))) >= octet_length(encode(text)) AS longer FROM documents")
def literal_escapes(spark: SparkSession, sf: str) -> DataFrame:
    """Every text as a literal, escaped and read back."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [None if t is None else text.escape_literal(t) for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "escaped": made, "back": [None if t is None else text.unescape_literal(t) for t in made], "n": [None if t is None else len(t.encode()) for t in f["text"]]})

    made = q._docs(spark, sf).select("doc_id", "text").mapInPandas(run, "doc_id long, escaped string, back string, n long")
    return made.select("doc_id", F.sha2(F.col("back").cast("binary"), 256).alias("sha"), (F.octet_length("escaped") >= F.col("n")).alias("longer"))


@query(f"WITH {q.PIECES} SELECT id AS doc_id, ordinal::BIGINT AS ordinal, s AS start, e AS end FROM hashed")
def large_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Where each chunk of a file begins and ends, from the chunks' sizes alone."""
    c = chunk.chunk_blobs(q._blobs(spark, sf), ["id"], "blob", q.SMALL).select("id", F.col("ordinal").cast("long").alias("ordinal"), F.octet_length("blob").cast("long").alias("size"))
    return files.with_offsets(c, "id", "ordinal").select(F.col("id").alias("doc_id"), "ordinal", "start", "end")


BY_SOURCE = f"""{q.PIECES}, placed AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY id, ordinal) AS pos, (instr('123456789abcdef', digest[1]) * 16 + instr('123456789abcdef', digest[2]))::BIGINT AS sig, digest, e - s AS size FROM hashed JOIN documents ON id = doc_id),
summed AS (SELECT *, sum(sig) OVER (PARTITION BY lang ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS t FROM placed),
may AS (SELECT lang, list(pos ORDER BY pos) AS l FROM summed WHERE pos >= 4 AND t % 8 = 1 GROUP BY lang),
cut AS (SELECT lang, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] >= 5 THEN list_concat(a, x) ELSE a END, [0::BIGINT]) AS c FROM may),
grouped AS (SELECT p.*, coalesce(len(list_filter(c.c, lambda x: x > 0 AND x < p.pos)), 0)::BIGINT AS g FROM placed p LEFT JOIN cut c USING (lang))"""


def _chunk_rows(blobs: DataFrame, *more: str) -> DataFrame:
    """The chunks of a language's documents, one after another, with their signatures and more columns of the documents."""
    c = chunk.chunk_blobs(blobs, ["id", "lang", *more], "blob", q.SMALL).withColumn("digest", digest.object_digest(F.col("blob")))
    return write_scratch(c.select(*more, "lang", F.struct("id", "ordinal").alias("at"), "digest", (F.col("end") - F.col("start")).alias("size"), chunk.signature8("digest").alias("signature")), "chunks")


@query(f"WITH {BY_SOURCE} SELECT lang, g AS \"group\", count(*) AS chunks, sum(size)::BIGINT AS bytes, (sum(sig) % 256)::INTEGER AS signature FROM grouped GROUP BY lang, g")
def chunk_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of chunks: runs of chunks that end where the rolling sum of four signatures says so."""
    rows = chunk.group_rows(_chunk_rows(q._blobs(spark, sf)), ["lang"], "at", "signature", minimum=4, window=4, log2_modulus=3)
    return rows.groupBy("lang", "group").agg(F.count("*").alias("chunks"), F.sum("size").alias("bytes"), (F.sum("signature") % 256).cast("int").alias("signature"))


@query(f"WITH {q.PIECES}, d AS (SELECT lang, sum(e - s)::BIGINT AS size, count(*) AS n FROM hashed JOIN documents ON id = doc_id GROUP BY lang) SELECT lang, size, n > 16 AS deep, n AS leaves FROM d")
def large_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Large objects of large objects: each file's size, whether it needs more than one level, and its leaves, counted through all levels."""
    blobs = q._blobs(spark, sf).where("id is not null")  # as SQL has it, a null text is a leaf, and a language of such texts only has no size
    rows = _chunk_rows(blobs.select("id", "lang", F.col("blob").isNotNull().alias("known"), F.coalesce("blob", F.lit(b"")).alias("blob")), "known")
    placed = files.long_offsets(rows, "lang", "at")
    child = F.struct(F.lit("small").alias("kind"), "digest", "size", F.lit(0).cast("smallint").alias("depth"))
    refs, objects = files.hierarchy(placed.select("lang", "place", "start", "end", child.alias("child"), "signature"), "lang", 16, order="place", minimum=4, log2_modulus=3)
    objects = write_scratch(objects.dropDuplicates(["digest"]).select(F.col("digest").alias("_d"), "blob", "refs"), "objects")
    refs, leaves = write_scratch(refs, "refs"), None
    now = refs.select("lang", F.lit(0).cast("long").alias("base"), "child")
    while True:
        stored = now.join(objects, F.col("child.digest") == F.col("_d")).select("lang", "base", "child.size", "child.depth", "blob", "refs")
        level = write_scratch(encode.decoded_larges(stored, ["lang", "base"]).withColumn("base", F.col("base") + F.col("start")), "level")
        found = level.where("child.kind = 'small'").select("lang", "base", "child")
        leaves = found if leaves is None else leaves.unionByName(found)
        now = level.where("child.kind = 'large'").select("lang", "base", "child")
        if now.isEmpty():
            break
    counted = leaves.groupBy("lang").agg(F.count("*").alias("leaves"), F.max(F.col("base") + F.col("child.size")).alias("size"))
    known = rows.groupBy(F.struct("lang").alias("_lang")).agg(F.max("known").alias("known"))
    counted = counted.select(F.struct("lang").alias("_lang"), "leaves", "size").join(known, "_lang")
    size = F.when(F.col("known"), F.col("size"))
    return refs.select("lang", F.struct("lang").alias("_lang"), (F.col("child.depth") > 1).alias("deep")).join(counted, "_lang").select("lang", size.alias("size"), "deep", "leaves")


# --- caches and indexes


KNOWN = f"SELECT o.k FROM ({q.OLD}) o JOIN ({q.NEW}) n ON o.k = n.k WHERE o.number = n.number AND o.late > 0 AND n.late > 0 AND o.mtime = n.mtime"


def _cache(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    old, new = q._inodes(spark, sf)
    child = F.struct(F.lit("small").alias("kind"), F.col("path").cast("string").cast("binary").alias("digest"), F.lit(1).cast("long").alias("size"), F.lit(0).cast("smallint").alias("depth"))
    return old.withColumn("child", child), new


@query(f"SELECT k AS path FROM ({q.NEW}) WHERE k NOT IN ({KNOWN}) OR k % 5 = 0")
def cache_to_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Files that must be read: their cache entry is not sure to hold, or its object is not stored."""
    old, new = _cache(spark, sf)
    return index.to_hash(old, new, old.where("path % 5 <> 0").select("child.digest")).select("path")


@query(f"SELECT k AS path, true AS fresh FROM ({KNOWN}) UNION ALL SELECT c_custkey, false FROM customer WHERE c_mktsegment = 'BUILDING'")
def cache_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """A cache after snapshots were resolved: those whose files are sure not to have changed, beside what it had."""
    old, new = _cache(spark, sf)
    had = spark.read.parquet(f"{sf}/customer.parquet").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("path"), F.lit(None).cast(encode.REF).alias("child"), F.lit(None).cast(old.schema["inode"].dataType).alias("inode"))
    after = index.resolve(had, old, new)
    sure = old.join(index.status(old, new).where("unchanged").select("path"), "path", "left_semi")
    if index.resolve(had, sure, new, required=True).count() != after.count():
        raise StoreError("files that have not changed must resolve")
    return after.select("path", F.col("child").isNotNull().alias("fresh"))


@query("""WITH e AS (SELECT concat_ws('/', p_brand, p_type, p_partkey) AS path, * FROM part), i AS (SELECT path, CASE WHEN p_brand = 'Brand#11' THEN 'dirty' ELSE 'clean' END AS hygiene, p_size > 40 OR p_brand = 'Brand#21' AS tracked, p_size < 5 AS added, p_brand = 'Brand#22' AS cached FROM e WHERE p_partkey % 2 = 0)
SELECT path, hygiene, tracked, added, cached FROM i WHERE tracked OR added OR cached UNION ALL SELECT path, 'dirty', false, true, false FROM e WHERE p_partkey % 2 = 1 AND path LIKE 'Brand#3%'""")
def index_maintain(spark: SparkSession, sf: str) -> DataFrame:
    """An index of every other part: paths tracked, hashes recorded, empty entries pruned, new files registered."""
    idx, there = q._index(spark, sf)
    key = F.element_at(F.split("path", "/"), -1).cast("long")
    idx, there = idx.where(key % 2 == 0), there.unionByName(idx.select("path", "metadata")).dropDuplicates(["path"]).unionByName(idx.where("false").select("path", "metadata"))
    everything = q._index(spark, sf)[0].select("path", "metadata")
    idx = index.set_tracked(idx, idx.where(F.startswith("path", F.lit("Brand#21"))).select("path"), True)
    hashed = idx.where(F.startswith("path", F.lit("Brand#22"))).select("path", F.lit(b"d").alias("digest"), F.lit(1).cast("long").alias("size"))
    idx = index.prune_index(index.clean_index(idx, hashed))
    new = everything.where(F.element_at(F.split("path", "/"), -1).cast("long") % 2 == 1)
    return index.register(idx, new, "Brand#3*/**").select("path", "hygiene", "tracked", "added", F.col("cached").isNotNull().alias("cached"))


@query("SELECT path, action FROM (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'delete' WHEN a.path IS NOT NULL AND a.sha = b.sha THEN 'keep' ELSE 'write' END AS action FROM (" + FILES.format(O.SNAPSHOT_A) + ") a FULL JOIN (" + FILES.format(O.SNAPSHOT_B) + ") b ON a.path = b.path)")
def checkout_plan(spark: SparkSession, sf: str) -> DataFrame:
    """What a checkout of B over the files of A does with each path."""
    return working_tree.plan_checkout(q._leaves(q._blobs(spark, sf)), q._leaves(q._snapshot_b(spark, sf))).select(q._path(), "action")


# --- streams


@query("WITH src AS (SELECT event_type AS id, encode(string_agg(props, '' ORDER BY event_id)) AS blob FROM events GROUP BY event_type), " + O.cuts_of("src", 256, 6, 1) + " SELECT id AS stream, s AS start, e AS end, sha256(src.blob[s + 1:e]) AS sha FROM ranges JOIN src USING (id)")
def stream_chunks_closed(spark: SparkSession, sf: str) -> DataFrame:
    """All chunks of streams whose last rows close them, put into a store as they come."""
    table = spark.read.parquet(f"{sf}/events.parquet")
    last = table.groupBy("event_type").agg(F.max("event_id").alias("event_id"), F.lit(True).alias("last"))
    ready = new_path(spark, "arrivals")
    rows = table.join(last, ["event_type", "event_id"], "left").select(F.col("event_type").alias("stream"), F.col("event_id").alias("seq"), F.col("props").cast("binary").alias("data"), F.coalesce("last", F.lit(False)).alias("last"))
    rows.repartitionByRange(3, "seq").write.parquet(ready)
    arrivals = spark.readStream.schema(rows.schema).parquet(ready)
    out = new_path(spark, "streamed")
    chunks = ingest.chunk_stream(arrivals, q.SMALL)
    chunks.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    store = Store.init(spark, new_path(spark, "store"))
    found = spark.read.schema(ingest.CHUNK).parquet(out)
    store.put(_objects(found.select("blob")))
    stored = store.objects().select("digest", F.sha2("blob", 256).alias("sha"))
    return found.withColumn("digest", digest.object_digest(F.col("blob"))).join(stored, "digest").select("stream", "start", "end", "sha")
