"""Queries over the driver's tables, one or more for each operator, each with its SQL where SQL can state it.

The virtual repository: a document is the file ``lang/source/doc_<id>``.
Snapshot A is all documents; snapshot B lacks source src7, has an exclamation
mark after every text of src3, and new copies of the documents of src5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import binary, digest, render, state, text
from siltstone.operators import batch, chunk, dag, diff, encode, files, index, references, tree
from siltstone.plans import oracle as O
from siltstone.sources.tables import new_path, write_scratch
from siltstone.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Chunks of a few hundred bytes, so that documents have several.
SMALL = chunk.Parameters(1, 256, 6, 1)
CHUNKED = O.cuts_of("src", 256, 6, 1)
SRC = "src AS (SELECT doc_id AS id, encode(text) AS blob FROM documents)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _blobs(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select(F.col("doc_id").alias("id"), "lang", "source", F.col("text").cast("binary").alias("blob"))


def _snapshot_b(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    kept = d.where("source <> 'src7'").withColumn("text", F.when(F.col("source") == "src3", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    more = d.where("source = 'src5'").withColumn("doc_id", F.col("doc_id") + 1000000)
    return kept.unionByName(more).select(F.col("doc_id").alias("id"), "lang", "source", F.col("text").cast("binary").alias("blob"))


def _leaves(snapshot: DataFrame) -> DataFrame:
    """path and child of each document as one small object."""
    child = F.struct(F.lit("small").alias("kind"), digest.object_digest(F.col("blob")).alias("digest"), F.octet_length("blob").cast("long").alias("size"), F.lit(0).cast("smallint").alias("depth"))
    return snapshot.select(F.array("lang", "source", F.concat(F.lit("doc_"), "id")).alias("path"), child.alias("child"))


def _flat(snapshot: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The flat tree of a snapshot (directories with their digests), the root, and the tree objects."""
    root, objects = tree.build_tree(write_scratch(_leaves(snapshot), "leaves"))
    objects = write_scratch(objects.dropDuplicates(["digest"]), "trees")
    return tree.flatten(objects, bytes(root.first()["child"]["digest"])), root, objects


def _built(leaves: DataFrame) -> tuple[bytes, DataFrame]:
    """The digest of a tree's root and its tree objects, written."""
    root, objects = tree.build_tree(write_scratch(leaves, "leaves"))
    return bytes(root.first()["child"]["digest"]), write_scratch(objects.dropDuplicates(["digest"]), "trees")


def _stored_changes(spark: SparkSession, sf: str) -> DataFrame:
    (a, of_a), (b, of_b) = (_built(_leaves(s)) for s in (_blobs(spark, sf), _snapshot_b(spark, sf)))
    return diff.stored_changes(of_a.unionByName(of_b).dropDuplicates(["digest"]), a, b)


def _path(c: str = "path") -> Column:
    return F.array_join(c, "/").alias(c)


def _hex(c: str = "digest") -> Column:
    return binary.lower_hex(c)


# --- digests and encodings


@query(f"SELECT doc_id, {O.digest('encode(text)')} AS digest FROM documents")
def canonical_small_digest(spark: SparkSession, sf: str) -> DataFrame:
    return _blobs(spark, sf).select(F.col("id").alias("doc_id"), binary.lower_hex(digest.object_digest(F.col("blob"))).alias("digest"))


@query()
def canonical_small_digest_sha3(spark: SparkSession, sf: str) -> DataFrame:
    return _blobs(spark, sf).select(F.col("id").alias("doc_id"), binary.lower_hex(digest.object_digest(F.col("blob"), None, "SHA-3-256")).alias("digest"))


@query(f"SELECT doc_id, lower(hex(encode('{O.HASH}') || unhex('00') || {O.leb('32')} || {O.leb('octet_length(encode(text))::BIGINT')} || unhex('0000') || unhex(sha256(encode(text))))) AS form, octet_length(encode(text))::BIGINT AS blob_len, sha256(encode(text)) AS blob_digest FROM documents")
def canonical_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    made = _blobs(spark, sf).select("id", digest.canonical(F.col("blob"), None).alias("form"))
    back = made.withColumn("back", digest.decoded_canonical(F.col("form")))
    return back.select(F.col("id").alias("doc_id"), _hex("form").alias("form"), "back.blob_len", _hex("back.blob_digest").alias("blob_digest"))


@query(f"SELECT event_id, lower(hex({O.leb('event_id')})) AS short, lower(hex({O.leb('user_id * 1000 + 127')})) AS long FROM events")
def leb128_numbers(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", binary.lower_hex(binary.leb128("event_id")).alias("short"), binary.lower_hex(binary.leb128(F.col("user_id") * 1000 + 127)).alias("long"))


@query("SELECT doc_id, sha256(encode(octet_length(encode(text)) || ':' || text || ',')) AS net, lower(hex(encode(octet_length(encode(lang)) || ':' || lang || ',' || octet_length(encode(source)) || ':' || source || ','))) AS path FROM documents")
def netstrings(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.sha2(binary.netstring("text"), 256).alias("net"), binary.lower_hex(text.encode_path(F.array("lang", "source"))).alias("path"))


@query(f"SELECT doc_id, substr(d, 1, 8) AS short, base64(encode('BLOB') || unhex(d)) AS name, substr(d, 1, 2) || '/' || substr(d, 3, 2) || '/' || substr(d, 5) AS shard FROM (SELECT doc_id, {O.digest('encode(text)')} AS d FROM documents)")
def object_names(spark: SparkSession, sf: str) -> DataFrame:
    d = _blobs(spark, sf).select("id", digest.object_digest(F.col("blob")).alias("d"))
    return d.select(F.col("id").alias("doc_id"), binary.abbreviated("d").alias("short"), binary.object_name("d").alias("name"), binary.shard_path(binary.parse_digest(binary.lower_hex("d"))).alias("shard"))


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 5400 SECOND, '%a, %d %b %Y %H:%M:%S') || ' +0130' AS east, strftime(o_orderdate - INTERVAL 25200 SECOND, '%a, %d %b %Y %H:%M:%S') || ' -0700' AS west FROM orders")
def rfc2822_dates(spark: SparkSession, sf: str) -> DataFrame:
    # Times without a zone count as UTC, whatever the session's time zone is.
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.unix_seconds(F.to_utc_timestamp(F.col("o_orderdate").cast("timestamp"), "UTC")).alias("s"))
    return o.select("o_orderkey", text.rfc2822("s", F.lit(5400)).alias("east"), text.rfc2822("s", F.lit(-25200)).alias("west"))


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host,
  list_filter(str_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '')::VARCHAR[] AS parts FROM pages""")
def url_paths(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", text.url_parts("url").alias("u"))
    return p.select("page_id", "u.scheme", "u.host", text.split_path(F.coalesce("u.path", F.lit(""))).alias("parts"))


@query("""SELECT doc_id, [lang, source] AS path, 2 AS depth, ['docs', lang, source] AS front, [lang, source, 'x'] AS back, ['base', lang, source] AS based FROM documents""")
def path_functions(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select("doc_id", text.guarded(text.split_path(F.concat_ws("/", "lang", "source"))).alias("path"))
    based = text.with_base(F.array(F.lit("base")), F.col("path"))
    return d.select("doc_id", "path", text.path_depth("path").alias("depth"), text.push_front("path", F.lit("docs")).alias("front"), text.push_back("path", F.lit("x")).alias("back"), based.alias("based"))


@query("""WITH refs AS (SELECT n_name AS ref FROM nation UNION ALL SELECT r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'HEAD' UNION ALL SELECT c_name FROM customer UNION ALL SELECT p_name FROM part)
SELECT ref, CASE WHEN ref = 'HEAD' THEN 'head' WHEN regexp_full_match(ref, '\\w+') THEN 'local' WHEN regexp_full_match(ref, '\\w+/\\w+') THEN 'remote' END AS kind,
  CASE WHEN regexp_full_match(ref, '\\w+/\\w+') THEN split_part(ref, '/', 1) END AS remote,
  CASE WHEN ref = 'HEAD' THEN NULL WHEN regexp_full_match(ref, '\\w+') THEN ref WHEN regexp_full_match(ref, '\\w+/\\w+') THEN split_part(ref, '/', 2) END AS branch FROM refs""")
def ref_parse(spark: SparkSession, sf: str) -> DataFrame:
    n, r = spark.read.parquet(f"{sf}/nation.parquet"), spark.read.parquet(f"{sf}/region.parquet")
    refs = n.select(F.col("n_name").alias("ref")).union(n.join(r, n.n_regionkey == r.r_regionkey).select(F.concat_ws("/", "r_name", "n_name"))).union(spark.createDataFrame([("HEAD",)], "ref string"))
    refs = refs.union(spark.read.parquet(f"{sf}/customer.parquet").select("c_name")).union(spark.read.parquet(f"{sf}/part.parquet").select("p_name"))
    return refs.select("ref", text.parse_ref("ref").alias("p")).select("ref", "p.kind", "p.remote", "p.branch")


# --- chunking


@query(f"WITH {SRC}, {O.bytes_of('src')}, sums AS (SELECT id, pos, sum(v) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN 255 PRECEDING AND CURRENT ROW) AS t FROM b) SELECT id AS doc_id, pos AS end FROM sums WHERE pos >= 256 AND t % 64 = 1")
def chunk_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.candidate_ends(_blobs(spark, sf), ["id"], "blob", SMALL).select(F.col("id").alias("doc_id"), "end")


@query(f"WITH {SRC}, {CHUNKED} SELECT id AS doc_id, ordinal, s AS start, e AS end FROM ranges")
def chunk_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.chunks(_blobs(spark, sf), ["id"], "blob", SMALL, keep_empty=False).withColumnRenamed("id", "doc_id")


@query(f"WITH {SRC}, {CHUNKED} SELECT id AS doc_id, list(e ORDER BY e)[:-2] AS cuts FROM ranges GROUP BY id")
def chunk_cuts_by_fold(spark: SparkSession, sf: str) -> DataFrame:
    b = _blobs(spark, sf)
    ends = chunk.candidate_ends(b, ["id"], "blob", SMALL).groupBy("id").agg(F.array_sort(F.collect_list("end")).alias("ends"))
    size = b.select("id", F.octet_length("blob").cast("long").alias("n"))
    cuts = size.join(ends, "id", "left").select("id", "n", chunk.chosen_cuts(F.coalesce("ends", F.array().cast("array<bigint>")), 256).alias("cuts"))
    return cuts.select(F.col("id").alias("doc_id"), F.filter("cuts", lambda x: x < F.col("n")).alias("cuts"))


@query(f"WITH {SRC}, {O.cuts_of('src', 256, 6, 1, before=True)} SELECT id AS doc_id, ordinal, s AS start, e AS end FROM ranges WHERE e > s")
def chunk_before_cut(spark: SparkSession, sf: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(i, k, a, b) for i, data in zip(f["id"], f["blob"], strict=True) for k, (a, b) in enumerate(chunk.split_before(bytes(data), 256, 6, 1))], columns=["doc_id", "ordinal", "start", "end"])

    return _blobs(spark, sf).where("blob is not null").select("id", "blob").mapInPandas(run, "doc_id long, ordinal int, start long, end long")


@query("WITH src AS (SELECT source AS id, encode(string_agg(text, '' ORDER BY doc_id)) AS blob FROM documents GROUP BY source), " + O.cuts_of("src", 8192, 14, 1) + " SELECT id AS source, ordinal, s AS start, e AS end FROM ranges")
def chunk_default_params(spark: SparkSession, sf: str) -> DataFrame:
    found = chunk.long_chunks(_docs(spark, sf), ["source"], "doc_id", "text")
    return found.withColumn("ordinal", F.col("ordinal").cast("int"))


@query(f"WITH {SRC}, {CHUNKED}, sized AS (SELECT lang, e - s AS size FROM ranges JOIN documents ON id = doc_id) SELECT lang, count(*) AS chunks, min(size) AS least, round(avg(size), 6) AS mean, max(size) AS most, round(stddev_pop(size), 6) AS deviation FROM sized GROUP BY lang")
def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("end") - F.col("start")
    c = chunk.chunks(_blobs(spark, sf), ["id", "lang"], "blob", SMALL, keep_empty=False).withColumn("size", size)
    return c.groupBy("lang").agg(F.count("*").alias("chunks"), F.min("size").alias("least"), F.round(F.avg("size"), 6).alias("mean"), F.max("size").alias("most"), F.round(F.stddev_pop("size"), 6).alias("deviation"))


PIECES = f"{SRC}, {CHUNKED}, piece AS (SELECT id, ordinal, s, e, src.blob[s + 1:e] AS data FROM ranges JOIN src USING (id)), hashed AS (SELECT id, ordinal, s, e, data, {O.digest('data')} AS digest FROM piece)"


@query(f"WITH {PIECES}, per AS (SELECT source, id, digest, e - s AS size FROM hashed JOIN documents ON id = doc_id) SELECT p.source, count(DISTINCT id) AS docs, sum(size)::BIGINT AS bytes, count(*) AS chunks, count(DISTINCT digest) AS distinct_chunks, any_value(u.stored)::BIGINT AS stored_bytes, round(any_value(u.stored) / sum(size), 6) AS stored_share FROM per p JOIN (SELECT source, sum(size) AS stored FROM (SELECT DISTINCT source, digest, size FROM per) GROUP BY source) u ON u.source = p.source GROUP BY p.source")
def chunk_dedup_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: what content-defined chunking saves within each source."""
    c = chunk.chunk_blobs(_blobs(spark, sf), ["id", "source"], "blob", SMALL)
    c = c.select("source", "id", digest.object_digest(F.col("blob")).alias("digest"), (F.col("end") - F.col("start")).alias("size"))
    by_chunk = c.groupBy("source", "digest").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    chunks_ = by_chunk.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("n").alias("chunks"), F.count("*").alias("distinct_chunks"), F.sum("size").alias("stored_bytes"))
    docs = _docs(spark, sf).groupBy("source").agg(F.count_distinct("doc_id").alias("docs"))
    return docs.join(chunks_, "source").select("source", "docs", "bytes", "chunks", "distinct_chunks", "stored_bytes", F.round(F.col("stored_bytes") / F.col("bytes"), 6).alias("stored_share"))


# --- files as objects

SHARED = f"""{PIECES}, counted AS (SELECT id, count(*) AS n, max(e) AS size FROM hashed GROUP BY id),
firsts AS (SELECT *, min(ordinal) OVER (PARTITION BY id, digest) AS f FROM hashed), indexed AS (SELECT *, dense_rank() OVER (PARTITION BY id ORDER BY f) - 1 AS ref FROM firsts),
blobs AS (SELECT id, string_agg(s || ' ' || e || ' ' || ref || chr(10), '' ORDER BY s) AS t FROM indexed GROUP BY id),
refs AS (SELECT id, string_agg(digest, '' ORDER BY ref) AS refs FROM (SELECT DISTINCT id, ref, digest FROM indexed) GROUP BY id)"""


@query(f"WITH {SHARED} SELECT c.id AS doc_id, CASE WHEN n > 1 THEN 'large' ELSE 'small' END AS kind, CASE WHEN n > 1 THEN 1 ELSE 0 END AS depth, c.size AS size, CASE WHEN n > 1 THEN {O.digest('encode(b.t)', 'r.refs')} ELSE h.digest END AS digest FROM counted c JOIN hashed h ON h.id = c.id AND h.ordinal = 0 JOIN blobs b ON b.id = c.id JOIN refs r ON r.id = c.id")
def share_files(spark: SparkSession, sf: str) -> DataFrame:
    refs, _ = files.share(_blobs(spark, sf), "id", "blob", SMALL)
    return refs.select(F.col("id").alias("doc_id"), "child.kind", F.col("child.depth").cast("int").alias("depth"), "child.size", _hex("child.digest").alias("digest"))


@query(f"WITH {SHARED} SELECT id AS doc_id, s AS start, e AS end, ref::BIGINT AS ref, digest FROM indexed")
def large_entries(spark: SparkSession, sf: str) -> DataFrame:
    c = chunk.chunk_blobs(_blobs(spark, sf), ["id"], "blob", SMALL).select("id", "start", "end", digest.object_digest(F.col("blob")).alias("digest"))
    placed = encode.with_ref_index(c, "id", "start", F.col("digest"))
    return placed.select(F.col("id").alias("doc_id"), "start", "end", F.col("ref").cast("long").alias("ref"), _hex().alias("digest"))


@query(f"WITH {SHARED} SELECT i.id AS doc_id, i.s AS start, i.e AS end, i.digest FROM indexed i JOIN counted c ON c.id = i.id WHERE n > 1")
def large_decode(spark: SparkSession, sf: str) -> DataFrame:
    refs, objects = files.share(_blobs(spark, sf), "id", "blob", SMALL)
    big = refs.where("child.kind = 'large'").select("id", "child.*").join(objects.dropDuplicates(["digest"]), "digest")
    e = encode.decoded_larges(big, ["id"])
    return e.select(F.col("id").alias("doc_id"), "start", "end", _hex("child.digest").alias("digest"))


def _entries(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = chunk.chunk_blobs(_blobs(spark, sf), ["id"], "blob", SMALL).withColumn("digest", digest.object_digest(F.col("blob")))
    child = F.struct(F.lit("small").alias("kind"), "digest", (F.col("end") - F.col("start")).alias("size"), F.lit(0).cast("smallint").alias("depth"))
    return c.select("id", "start", "end", child.alias("child")), c.select("digest", "blob").dropDuplicates(["digest"])


@query(f"WITH {PIECES} SELECT id AS doc_id, s AS start, e AS end, digest FROM hashed WHERE s < 2000 AND e > 1000")
def large_range_read(spark: SparkSession, sf: str) -> DataFrame:
    entries, _ = _entries(spark, sf)
    return files.overlapping(entries, 1000, 2000).select(F.col("id").alias("doc_id"), "start", "end", _hex("child.digest").alias("digest"))


@query("SELECT doc_id, sha256(encode(text)) AS sha, octet_length(encode(text))::BIGINT AS size FROM documents")
def large_reassemble(spark: SparkSession, sf: str) -> DataFrame:
    entries, objects = _entries(spark, sf)
    return files.reassembled(entries, objects, "id").select(F.col("id").alias("doc_id"), F.sha2("data", 256).alias("sha"), F.octet_length("data").cast("long").alias("size"))


# --- stores

TWO = f"a AS ({O.SNAPSHOT_A}), b AS ({O.SNAPSHOT_B}), da AS (SELECT {O.digest('blob')} AS digest, octet_length(blob)::BIGINT AS size FROM a), db AS (SELECT {O.digest('blob')} AS digest, octet_length(blob)::BIGINT AS size FROM b)"


def _digests(snapshot: DataFrame) -> DataFrame:
    return snapshot.select(digest.object_digest(F.col("blob")).alias("digest"), F.octet_length("blob").cast("long").alias("size"))


@query(f"WITH {TWO} SELECT DISTINCT digest, size FROM db WHERE digest NOT IN (SELECT digest FROM da)")
def put_new_objects(spark: SparkSession, sf: str) -> DataFrame:
    new = _digests(_snapshot_b(spark, sf)).dropDuplicates(["digest"]).join(_digests(_blobs(spark, sf)).select("digest"), "digest", "left_anti")
    return new.select(_hex().alias("digest"), "size")


@query(f"WITH {TWO} SELECT digest, size FROM db WHERE digest IN (SELECT digest FROM da)")
def resolve_refs(spark: SparkSession, sf: str) -> DataFrame:
    return _digests(_snapshot_b(spark, sf)).join(_digests(_blobs(spark, sf)).select("digest"), "digest", "left_semi").select(_hex().alias("digest"), "size")


@query(f"WITH {TWO} SELECT DISTINCT digest FROM da WHERE starts_with(digest, '0a')")
def prefix_search(spark: SparkSession, sf: str) -> DataFrame:
    return _digests(_blobs(spark, sf)).select("digest").distinct().where(F.startswith("digest", F.lit(b"\x0a"))).select(_hex().alias("digest"))


@query(f"WITH {TWO} SELECT count(*) AS refs, count(DISTINCT digest) AS objects, sum(size)::BIGINT AS bytes FROM da")
def object_count(spark: SparkSession, sf: str) -> DataFrame:
    return _digests(_blobs(spark, sf)).agg(F.count("*").alias("refs"), F.count_distinct("digest").alias("objects"), F.sum("size").alias("bytes"))


# --- trees

TREE_A = O.objects_of(O.SNAPSHOT_A)
TREES = f"{O.objects_of(O.SNAPSHOT_A, 'x_')}, {O.objects_of(O.SNAPSHOT_B, 'y_')}"


@query(f"WITH {TREE_A} SELECT digest FROM root")
def tree_root_digest(spark: SparkSession, sf: str) -> DataFrame:
    root, _ = tree.build_tree(_leaves(_blobs(spark, sf)))
    return root.select(_hex("child.digest").alias("digest"))


@query(f"WITH {TREE_A} SELECT lang, source, sha256(encode(t)) AS blob, length(refs) // 64 AS n_refs FROM a_text JOIN a_refs USING (lang, source)")
def tree_encode_level(spark: SparkSession, sf: str) -> DataFrame:
    named = _leaves(_blobs(spark, sf)).select(F.concat_ws("/", F.slice("path", 1, 2)).alias("parent"), F.element_at("path", -1).alias("name"), "child")
    part = F.split("parent", "/")
    return encode.encode_tree(named).select(part[0].alias("lang"), part[1].alias("source"), F.sha2("blob", 256).alias("blob"), F.size("refs").cast("long").alias("n_refs"))


@query(f"WITH {TREE_A} SELECT path, kind, digest, size FROM tree")
def tree_flatten(spark: SparkSession, sf: str) -> DataFrame:
    flat, _, _ = _flat(_blobs(spark, sf))
    return flat.select(_path(), "child.kind", _hex("child.digest").alias("digest"), "child.size")


@query(f"WITH {TREE_A}, wanted AS (SELECT lang || '/' || source || '/doc_' || doc_id AS path FROM documents UNION ALL SELECT lang || '/' || source || '/doc_' || (doc_id + 1000000) FROM documents WHERE source = 'src5') SELECT w.path, t.kind, t.digest FROM wanted w LEFT JOIN tree t USING (path)")
def path_lookup(spark: SparkSession, sf: str) -> DataFrame:
    root, objects = _built(_leaves(_blobs(spark, sf)))
    d = _docs(spark, sf).select("lang", "source", "doc_id")
    wanted = d.unionByName(d.where("source = 'src5'").withColumn("doc_id", F.col("doc_id") + 1000000)).select(F.array("lang", "source", F.concat(F.lit("doc_"), "doc_id")).alias("path"))
    return tree.look_up(tree.flatten(objects, root, wanted), wanted).select(_path(), "child.kind", _hex("child.digest").alias("digest"))


@query(f"WITH {TREE_A} SELECT name, kind, size, digest FROM tree WHERE parent = 'en'")
def show_directory(spark: SparkSession, sf: str) -> DataFrame:
    root, objects = _built(_leaves(_blobs(spark, sf)))
    return tree.listing(objects, root, ["en"]).select("name", "kind", "size", _hex().alias("digest"))


@query(f"WITH {TREES} SELECT CASE WHEN y.path IS NULL THEN 'removed' WHEN x.path IS NULL THEN 'added' ELSE 'modified' END AS change, coalesce(x.path, y.path) AS path FROM (SELECT * FROM x_tree WHERE kind <> 'tree') x FULL JOIN (SELECT * FROM y_tree WHERE kind <> 'tree') y ON x.path = y.path WHERE x.digest IS DISTINCT FROM y.digest")
def status_leaf_diff(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _leaves(_blobs(spark, sf)), _leaves(_snapshot_b(spark, sf))
    return diff.leaf_diff(a, b).select("change", _path())


CHANGES = """SELECT 'modified' AS change, x.path FROM x_tree x JOIN y_tree y USING (path) WHERE x.kind <> 'tree' AND y.kind <> 'tree' AND x.digest <> y.digest
UNION ALL SELECT 'removed', x.path FROM x_tree x WHERE x.path NOT IN (SELECT path FROM y_tree) AND (x.parent = '' OR x.parent IN (SELECT path FROM y_tree))
UNION ALL SELECT 'added', y.path FROM y_tree y WHERE y.path NOT IN (SELECT path FROM x_tree) AND (y.parent = '' OR y.parent IN (SELECT path FROM x_tree))"""


@query(f"WITH {TREES} {CHANGES}")
def status_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _stored_changes(spark, sf).select("change", _path())


@query(f"WITH {TREE_A} SELECT 'added' AS change, path FROM tree WHERE parent = ''")
def status_no_head(spark: SparkSession, sf: str) -> DataFrame:
    return diff.initial_changes(_flat(_blobs(spark, sf))[0]).select("change", _path())


RANGES_B = O.cuts_of("bsrc", 256, 6, 1, p="z")


@query(f"WITH {PIECES}, bsrc AS (SELECT id, blob FROM ({O.SNAPSHOT_B})), {RANGES_B}, zhashed AS (SELECT id, s, e, {O.digest('bsrc.blob[s + 1:e]')} AS digest FROM zranges JOIN bsrc USING (id)) SELECT id AS doc_id, s AS start, e AS end, digest FROM zhashed EXCEPT SELECT id, s, e, digest FROM hashed")
def range_delta(spark: SparkSession, sf: str) -> DataFrame:
    def entries(s: DataFrame) -> DataFrame:
        return chunk.chunk_blobs(s, ["id"], "blob", SMALL).select("id", "start", "end", digest.object_digest(F.col("blob")).alias("digest"))

    delta = files.range_delta(entries(_snapshot_b(spark, sf)), entries(_blobs(spark, sf)), ["id"])
    return delta.select(F.col("id").alias("doc_id"), "start", "end", _hex().alias("digest"))


# --- batches


def _operations(spark: SparkSession, sf: str) -> DataFrame:
    """What makes snapshot B of A, with an early edit of src3 that a later one overrides and a delete of nothing."""
    gone = _docs(spark, sf).where("source = 'src7'").select(F.lit(1).alias("seq"), F.array("lang", "source").alias("path")).distinct().select("seq", "path", F.lit("delete").alias("op"), F.lit(None).cast(encode.REF).alias("child"))
    none = spark.createDataFrame([(4, ["xx", "no", "thing"], "delete", None)], f"seq int, path array<string>, op string, child {encode.REF}")
    b = _leaves(_snapshot_b(spark, sf)).where("path[1] in ('src3', 'src5')")
    early = _leaves(_blobs(spark, sf)).where("path[1] = 'src3'")
    add = lambda rows, seq: rows.select(F.lit(seq).alias("seq"), "path", F.lit("add").alias("op"), "child")
    return gone.unionByName(none).unionByName(add(early, 2)).unionByName(add(b, 3))


@query(f"WITH {O.objects_of(O.SNAPSHOT_B)} SELECT path, digest, size FROM tree WHERE kind = 'small'")
def batch_apply(spark: SparkSession, sf: str) -> DataFrame:
    after = batch.apply_batch(_leaves(_blobs(spark, sf)), _operations(spark, sf))
    return after.select(_path(), _hex("child.digest").alias("digest"), "child.size")


@query(f"WITH {O.objects_of(O.SNAPSHOT_B)} SELECT digest FROM root")
def batch_root_digest(spark: SparkSession, sf: str) -> DataFrame:
    root, _ = tree.build_tree(write_scratch(batch.apply_batch(_leaves(_blobs(spark, sf)), _operations(spark, sf)), "leaves"))
    return root.select(_hex("child.digest").alias("digest"))


@query("WITH l AS (SELECT lang || '/' || source || '/doc_' || doc_id AS path, source FROM documents) SELECT DISTINCT lang || '/' || source AS path FROM documents WHERE source <> 'src7'")
def batch_prune_empty(spark: SparkSession, sf: str) -> DataFrame:
    """The directories that are left: those of src7 are empty and gone."""
    after = batch.apply_batch(_leaves(_blobs(spark, sf)), _operations(spark, sf))
    return tree.with_directories(after).where("kind = 'tree' and size(path) = 2").select(_path())


@query(f"WITH {TREES} SELECT y.path, CASE WHEN x.path IS NULL THEN 'delete' ELSE 'add' END AS op, x.digest FROM y_tree y LEFT JOIN x_tree x USING (path) WHERE y.kind = 'small'")
def unstage_paths(spark: SparkSession, sf: str) -> DataFrame:
    paths = _leaves(_snapshot_b(spark, sf)).select(F.lit(1).alias("seq"), "path")
    return batch.unstage(paths, _leaves(_blobs(spark, sf))).select(_path(), "op", _hex("child.digest").alias("digest"))


# --- histories: customer k is a commit with parents k // 2 and, below 64, k - 1

LINKS = "links AS (SELECT c_custkey AS p, c_custkey // 2 AS c FROM customer WHERE c_custkey > 1 UNION SELECT c_custkey, c_custkey - 1 FROM customer WHERE c_custkey < 64 AND c_custkey > 1)"
REACHED = f"{LINKS}, seen AS (SELECT max(c_custkey) AS k FROM customer UNION SELECT links.c FROM links JOIN seen ON links.p = seen.k)"


def _commits(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    parents = F.array_distinct(F.concat(F.when(k > 1, F.array(F.floor(k / 2))).otherwise(F.array().cast("array<bigint>")), F.when((k < 64) & (k > 1), F.array(k - 1)).otherwise(F.array().cast("array<bigint>"))))
    return spark.read.parquet(f"{sf}/customer.parquet").select(k.alias("digest"), parents.alias("parents"), F.floor(F.col("c_acctbal") * 100).alias("seconds"), "c_name")


def _newest(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/customer.parquet").agg(F.max("c_custkey").alias("node"))


@query(f"WITH RECURSIVE {REACHED} SELECT k AS node FROM seen")
def reachable_set(spark: SparkSession, sf: str) -> DataFrame:
    links = _commits(spark, sf).select(F.col("digest").alias("parent"), F.explode("parents").alias("child"))
    return dag.reachable(links, _newest(spark, sf))


@query(f"WITH RECURSIVE {REACHED} SELECT row_number() OVER (ORDER BY floor(c_acctbal * 100) DESC, c_custkey) AS place, c_custkey AS digest, c_name FROM customer JOIN seen ON k = c_custkey")
def commit_log(spark: SparkSession, sf: str) -> DataFrame:
    log = dag.history(_commits(spark, sf), _newest(spark, sf))
    return dag.numbered(log, "place", F.desc("seconds"), F.col("digest")).select("place", "digest", "c_name")


@query(f"WITH RECURSIVE {REACHED} SELECT k AS digest FROM seen WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def copy_missing(spark: SparkSession, sf: str) -> DataFrame:
    source = _commits(spark, sf).withColumnRenamed("parents", "refs")
    target = spark.read.parquet(f"{sf}/customer.parquet").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("digest"))
    return dag.copy_missing(source, target, _newest(spark, sf)).select("digest")


@query(r"""SELECT c_custkey, sha256(encode(CASE WHEN c_custkey > 1 THEN '1' ELSE '0' END || ' 0' || chr(10) || '_:author <http://xmlns.com/foaf/spec/#term_name> "' || c_name || '" .' || chr(10) || '_:this <urn:siltstone:commitMessage> "' || c_mktsegment || '" .' || chr(10) || '_:this <urn:siltstone:commitTimestamp> "' || strftime(make_timestamp(c_custkey * 86400000000), '%a, %d %b %Y %H:%M:%S') || ' +0000" .' || chr(10))) AS blob, CASE WHEN c_custkey > 1 THEN 2 ELSE 1 END AS refs FROM customer""")
def commit_encode(spark: SparkSession, sf: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                blob, refs = encode.encode_commit({"subtree": b"\0" * 32, "parents": [b"\1" * 32] if r.c_custkey > 1 else [], "seconds": r.c_custkey * 86400, "offset_s": 0, "name": r.c_name, "mbox": None, "message": r.c_mktsegment})
                rows.append((r.c_custkey, blob, len(refs)))
            yield pd.DataFrame(rows, columns=["c_custkey", "blob", "refs"])

    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")
    return c.mapInPandas(run, "c_custkey long, blob binary, refs int").select("c_custkey", F.sha2("blob", 256).alias("blob"), "refs")


# --- integrity: the stored objects of snapshot A, whole or with every text of src3 damaged


def _stored(spark: SparkSession, sf: str, damaged: bool) -> DataFrame:
    blobs = _blobs(spark, sf)
    small = blobs.groupBy(digest.object_digest(F.col("blob")).alias("digest")).agg(F.first("blob").alias("blob"), F.bool_or(F.col("source") == "src3").alias("bad"))
    data = F.when(F.col("bad"), F.concat("blob", F.lit(b"!"))).otherwise(F.col("blob")) if damaged else F.col("blob")
    none = F.array().cast("array<binary>")
    _, trees = tree.build_tree(_leaves(blobs))
    return small.select("digest", data.alias("blob"), none.alias("refs")).unionByName(trees.select("digest", "blob", "refs"))


DAMAGED = f"""{TREE_A}, bad AS (SELECT DISTINCT digest FROM leaf WHERE source = 'src3'), dirty AS (SELECT DISTINCT l.lang, l.source, d.digest FROM leaf l JOIN bad USING (digest) JOIN dirs d ON d.lang = l.lang AND d.name = l.source)"""


@query(f"WITH {TREE_A} SELECT digest AS stored FROM root WHERE false")
def fsck_clean(spark: SparkSession, sf: str) -> DataFrame:
    return dag.check_integrity(_stored(spark, sf, False)).select(_hex("stored").alias("stored"))


@query(f"WITH {DAMAGED} SELECT digest AS stored FROM bad UNION SELECT digest FROM dirty UNION SELECT DISTINCT g.digest FROM langs g JOIN dirty ON dirty.lang = g.name UNION SELECT root.digest FROM root WHERE EXISTS (SELECT 1 FROM bad)")
def fsck_corrupt_propagates(spark: SparkSession, sf: str) -> DataFrame:
    return dag.check_integrity(_stored(spark, sf, True)).select(_hex("stored").alias("stored"))


@query(f"WITH {DAMAGED} SELECT digest AS stored FROM bad")
def fsck_each(spark: SparkSession, sf: str) -> DataFrame:
    return dag.check_each(_stored(spark, sf, True)).select(_hex("stored").alias("stored"))


# --- caches and indexes: suppliers and customers play files that were seen and files that are there

OLD = "SELECT c_custkey AS k, c_nationkey AS number, floor(c_acctbal)::BIGINT AS mtime, c_custkey % 3 AS late FROM customer WHERE c_mktsegment <> 'BUILDING'"
NEW = "SELECT c_custkey AS k, CASE WHEN c_mktsegment = 'MACHINERY' THEN c_nationkey + 1 ELSE c_nationkey END AS number, CASE WHEN c_mktsegment = 'FURNITURE' THEN floor(c_acctbal)::BIGINT + 1 ELSE floor(c_acctbal)::BIGINT END AS mtime, c_custkey % 3 AS late FROM customer WHERE c_mktsegment <> 'AUTOMOBILE'"


def _inodes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = spark.read.parquet(f"{sf}/customer.parquet")

    def inode(number: Column, mtime: Column) -> Column:
        m = mtime.cast("long")
        return F.struct((m + F.col("c_custkey") % 3).alias("timestamp_ns"), F.lit(0).cast("long").alias("generation"), number.cast("long").alias("number"), F.lit(None).cast("long").alias("version"), m.alias("ctime_ns"), m.alias("mtime_ns"))

    mtime, seg = F.floor("c_acctbal"), F.col("c_mktsegment")
    old = c.where(seg != "BUILDING").select(F.col("c_custkey").alias("path"), F.lit(None).cast(encode.REF).alias("child"), inode(F.col("c_nationkey"), mtime).alias("inode"))
    new = c.where(seg != "AUTOMOBILE").select(F.col("c_custkey").alias("path"), inode(F.when(seg == "MACHINERY", F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")), F.when(seg == "FURNITURE", mtime + 1).otherwise(mtime)).alias("inode"))
    return old, new


@query(f"""SELECT coalesce(o.k, n.k) AS path, CASE WHEN n.k IS NULL THEN 'removed' WHEN o.k IS NULL THEN 'new' ELSE 'extant' END AS status,
  CASE WHEN o.k IS NOT NULL AND n.k IS NOT NULL THEN (o.number = n.number) AND (CASE WHEN o.late > 0 AND n.late > 0 THEN true END) AND (o.mtime = n.mtime) END AS unchanged FROM ({OLD}) o FULL JOIN ({NEW}) n ON o.k = n.k""")
def cache_status(spark: SparkSession, sf: str) -> DataFrame:
    return index.status(*_inodes(spark, sf)).select("path", "status", "unchanged")


@query("WITH v(x) AS (VALUES (true), (false), (NULL)) SELECT a.x AS a, b.x AS b, a.x AND b.x AS both, a.x OR b.x AS either, NOT a.x AS negated FROM v a, v b")
def certainty_tables(spark: SparkSession, sf: str) -> DataFrame:
    pairs = spark.createDataFrame([(a, b) for a in (True, False, None) for b in (True, False, None)], "a boolean, b boolean")
    a, b = F.col("a"), F.col("b")
    return pairs.select("a", "b", state.certainty_and(a, b).alias("both"), state.certainty_or(a, b).alias("either"), state.certainty_not(a).alias("negated"))


@query("SELECT event_id, epoch_us(ts) // 1000000 * 1000000000 + (epoch_us(ts) % 1000000) * 1000 AS ns, NULL::BIGINT AS beyond FROM events")
def ns_from_times(spark: SparkSession, sf: str) -> DataFrame:
    us = F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC"))
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", us.alias("us"))
    return e.select("event_id", state.ns_from(F.floor(F.col("us") / 1000000), F.col("us") % 1000000 * 1000).alias("ns"), state.ns_from(F.lit(1 << 40), F.lit(0)).alias("beyond"))


def _index(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """An index of parts with the time of their last change; files with some changed, some gone."""
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_brand", "p_type", "p_size", F.concat_ws("/", "p_brand", "p_type", F.col("p_partkey")).alias("path"))
    meta = lambda size: F.struct(F.col("p_size").cast("long").alias("mtime"), size.cast("long").alias("size"))
    idx = p.select("path", meta(F.col("p_size")).alias("metadata"), F.when(F.col("p_brand") == "Brand#11", "dirty").otherwise("clean").alias("hygiene"), (F.col("p_size") > 40).alias("tracked"), (F.col("p_size") < 5).alias("added"), F.lit(None).cast("struct<digest: binary, size: bigint>").alias("cached"))
    there = p.where("p_brand <> 'Brand#12'").select("path", meta(F.when(F.col("p_brand") == "Brand#13", F.col("p_size") + 1).otherwise(F.col("p_size"))).alias("metadata"))
    return idx, there


@query("SELECT concat_ws('/', p_brand, p_type, p_partkey) AS path, CASE WHEN p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 'dirty' WHEN 25 <= p_size THEN 'dodgy' ELSE 'clean' END AS hygiene FROM part")
def index_hygiene(spark: SparkSession, sf: str) -> DataFrame:
    return index.update_index(*_index(spark, sf), 25).select("path", "hygiene")


@query("SELECT path FROM (SELECT concat_ws('/', p_brand, p_type, p_partkey) AS path, * FROM part) WHERE (path LIKE 'Brand#1_/%' OR p_size > 40 OR p_size < 5) AND NOT regexp_full_match(path, '.*/[^/]*7')")
def index_select(spark: SparkSession, sf: str) -> DataFrame:
    return index.select_entries(_index(spark, sf)[0], "Brand#1?/**", "**/*7").select("path")


@query("SELECT path, regexp_full_match(path, 'Brand#[23][^/]/[^/]*/[^/]*') AS two, path LIKE '%STEEL%' OR path LIKE '%TIN%' AS metal FROM (SELECT concat_ws('/', p_brand, p_type, p_partkey) AS path FROM part)")
def glob_filter(spark: SparkSession, sf: str) -> DataFrame:
    idx = _index(spark, sf)[0]
    return idx.select("path", text.matches_glob("path", "Brand#[23]?/*/*").alias("two"), text.matches_glob("path", "**{STEEL,TIN}**").alias("metal"))


# --- branches: nations are branches, regions remotes


def _branches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    n, r = spark.read.parquet(f"{sf}/nation.parquet"), spark.read.parquet(f"{sf}/region.parquet")
    local = n.select(F.col("n_name").alias("branch"), F.col("n_nationkey").cast("long").alias("digest"))
    return local, n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("remote"), F.col("n_name").alias("branch"), (F.col("n_nationkey") + 100).cast("long").alias("digest"))


@query("SELECT 'local' AS kind, NULL AS remote, n_name AS branch, n_nationkey::BIGINT AS digest FROM nation UNION ALL SELECT 'remote', r_name, n_name, (n_nationkey + 100)::BIGINT FROM nation JOIN region ON n_regionkey = r_regionkey")
def branches_all(spark: SparkSession, sf: str) -> DataFrame:
    return references.all_branches(*_branches(spark, sf))


@query("SELECT n_name AS branch, n_nationkey::BIGINT AS digest, CASE WHEN n_regionkey < 2 THEN r_name || '/' || n_name END AS upstream, n_nationkey = (SELECT min(n_nationkey) FROM nation) AS is_head FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def branch_list(spark: SparkSession, sf: str) -> DataFrame:
    local, remote = _branches(spark, sf)
    n = spark.read.parquet(f"{sf}/nation.parquet")
    up = remote.join(n.where("n_regionkey < 2").select(F.col("n_name").alias("branch")), "branch", "left_semi").select("branch", "remote", F.col("branch").alias("remote_branch"))
    return references.branch_list(local, up, n.orderBy("n_nationkey").first()["n_name"])


@query("SELECT n_name AS branch, (n_nationkey + CASE WHEN n_regionkey = 2 THEN 100 ELSE 0 END)::BIGINT AS digest FROM nation")
def branch_merge_right(spark: SparkSession, sf: str) -> DataFrame:
    local, remote = _branches(spark, sf)
    n = spark.read.parquet(f"{sf}/nation.parquet").where("n_regionkey = 2").select(F.col("n_name").alias("branch"))
    return references.merged_right(local, remote.join(n, "branch", "left_semi").select("branch", "digest"), "branch")


@query("SELECT kind, remote, branch, CASE WHEN kind = 'local' THEN k::BIGINT WHEN kind = 'remote' THEN (k + 100)::BIGINT END AS digest FROM (SELECT 'local' AS kind, NULL AS remote, n_name AS branch, n_nationkey AS k FROM nation UNION ALL SELECT 'remote', r_name, n_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'local', NULL, r_name, NULL FROM region)")
def resolve_branches(spark: SparkSession, sf: str) -> DataFrame:
    local, remote = _branches(spark, sf)
    all_ = references.all_branches(local, remote)
    missing = spark.read.parquet(f"{sf}/region.parquet").select(F.lit("local").alias("kind"), F.lit(None).cast("string").alias("remote"), F.col("r_name").alias("branch"))
    refs = all_.select("kind", "remote", "branch").unionByName(missing)
    return references.resolved(refs, all_, None)


@query("SELECT n_name AS branch, n_nationkey::BIGINT AS digest FROM nation WHERE n_regionkey = 2 UNION ALL SELECT n_name, (n_nationkey + 100)::BIGINT FROM nation WHERE n_regionkey = 2")
def branch_cas_difference(spark: SparkSession, sf: str) -> DataFrame:
    local, _ = _branches(spark, sf)
    return references.symmetric_difference(local, branch_merge_right(spark, sf))


# --- texts for people


@query("""SELECT c_custkey, 'commit ' || c_custkey || chr(10) || CASE WHEN c_nationkey > 12 THEN 'author ' || c_name || ' <' || c_mktsegment || '>' || chr(10) WHEN c_nationkey > 6 THEN 'author ' || c_name || chr(10) WHEN c_nationkey > 3 THEN 'author <' || c_mktsegment || '>' || chr(10) ELSE '' END
  || 'date ' || strftime(make_timestamp(c_custkey * 86400000000) - INTERVAL 12600 SECOND, '%Y-%m-%d %H:%M:%S') || ' -03:30' || chr(10) || CASE WHEN c_acctbal > 0 THEN chr(9) || c_mktsegment || chr(10) ELSE '' END AS shown FROM customer""")
def render_commits(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet")
    n = F.col("c_nationkey")
    shown = render.commit_text(F.col("c_custkey").cast("string"), F.when((n > 6), F.col("c_name")), F.when((n > 12) | ((n > 3) & (n <= 6)), F.col("c_mktsegment")), F.col("c_custkey") * 86400, F.lit(-12600), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")))
    return c.select("c_custkey", shown.alias("shown"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey < 3 AND n_nationkey < 12 THEN 'On branch ' || n_name || ' with virtual workspace 0a0b' WHEN n_regionkey < 3 THEN 'On branch ' || n_name || ' without any virtual workspace' WHEN n_nationkey < 12 THEN 'No prior commit with virtual workspace 0a0b' ELSE 'No prior commit or virtual workspace' END AS header FROM nation")
def render_status(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.read.parquet(f"{sf}/nation.parquet")
    head = F.when(F.col("n_regionkey") < 3, F.concat(F.lit("branch "), "n_name"))
    return n.select("n_nationkey", render.status_header(head, F.when(F.col("n_nationkey") < 12, F.lit("0a0b"))).alias("header"))


@query(f"WITH {TREES} SELECT upper(change[1]) || change[2:] || '(' || path || ')' AS shown FROM ({CHANGES})")
def render_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _stored_changes(spark, sf).select(render.change_text(F.col("change"), F.col("path")).alias("shown"))


@query(f"WITH {TREE_A}, o AS (SELECT DISTINCT 0 AS children, digest, size FROM leaf UNION ALL SELECT DISTINCT (length(refs) // 64)::INTEGER, d.digest, octet_length(encode(t))::BIGINT FROM a_text JOIN a_refs USING (lang, source) JOIN dirs d ON d.lang = a_text.lang AND d.name = source UNION ALL SELECT DISTINCT (length(refs) // 64)::INTEGER, g.digest, octet_length(encode(t))::BIGINT FROM b_text JOIN b_refs USING (lang) JOIN langs g ON g.name = lang UNION ALL SELECT (length(refs) // 64)::INTEGER, '', octet_length(encode(t))::BIGINT FROM c_text JOIN c_refs USING (top)) SELECT children, count(*) AS objects, sum(size)::BIGINT AS blob_bytes FROM o GROUP BY children")
def object_summary(spark: SparkSession, sf: str) -> DataFrame:
    return files.summary(_stored(spark, sf, False))


# --- streams: the properties of a type's events, one after another, are a stream of bytes


@query("WITH src AS (SELECT event_type AS id, encode(string_agg(props, '' ORDER BY event_id)) AS blob FROM events GROUP BY event_type), " + O.cuts_of("src", 256, 6, 1) + ", closed AS (SELECT id, unnest(c[:-2]) AS s, unnest(c[2:]) AS e FROM cuts) SELECT id AS stream, s AS start, e AS end, sha256(src.blob[s + 1:e]) AS sha FROM closed JOIN src USING (id)")
def stream_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that are closed so far when the table is read as a stream."""
    # A plain path must be a folder for a stream; a pattern may match a file or a folder.
    events = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/event[s].parquet")
    arrivals = events.select(F.col("event_type").alias("stream"), F.col("event_id").alias("seq"), F.col("props").cast("binary").alias("data"), F.lit(False).alias("last"))
    out = new_path(spark, "streamed")
    chunks = ingest.chunk_stream(arrivals, SMALL)
    chunks.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(ingest.CHUNK).parquet(out).select("stream", "start", "end", F.sha2("blob", 256).alias("sha"))
