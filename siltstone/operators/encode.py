"""Typed objects as blobs with references, and back.

Blob formats (fixed): a Large's lines ``start end ref`` in order; a Tree's
netstrings ``ref data size depth name`` or ``ref tree name``, each followed by
a line feed, in order of names' bytes; a Commit's line ``parents 0`` followed
by sorted N-Triples.  ``ref`` is the position of a child's digest among the
object's distinct children in order of first appearance.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.binary import netstring, read_netstring
from siltstone.functions.text import escape_literal, format_rfc2822, parse_rfc2822, unescape_literal

#: Public vocabulary of authors; the commit terms' namespace is a parameter.
FOAF = "http://xmlns.com/foaf/spec/"
NAMESPACE = "urn:siltstone:"

REF = "struct<kind: string, digest: binary, size: bigint, depth: smallint>"


def with_ref_index(entries: DataFrame, parent: str, order: str, child: Column) -> DataFrame:
    """Adds ordinal (1-based place within the parent) and ref (0-based index of the child's first appearance)."""
    placed = entries.withColumn("ordinal", F.row_number().over(Window.partitionBy(parent).orderBy(order))).withColumn("_child", child)
    placed = placed.withColumn("_first", F.min("ordinal").over(Window.partitionBy(parent, "_child")))
    return placed.withColumn("ref", F.dense_rank().over(Window.partitionBy(parent).orderBy("_first")) - 1).drop("_first")


def _collected(lines: DataFrame, parent: str) -> DataFrame:
    """parent, blob, refs from rows (parent, ordinal, line, ref, _child); an object's lines are one blob by definition."""
    grouped = lines.groupBy(parent).agg(
        F.expr("listagg(line) WITHIN GROUP (ORDER BY ordinal)").alias("blob"),
        F.array_sort(F.collect_set(F.struct("ref", "_child"))).alias("children"),
    )
    return grouped.select(parent, F.coalesce("blob", F.lit(b"")).alias("blob"), F.col("children._child").alias("refs"))


def encode_large(entries: DataFrame, parent: str = "parent", order: str = "start") -> DataFrame:
    """parent, blob, refs from rows (parent, start, end, child STRUCT); a range must not be empty, unless another ``order`` tells where it stands."""
    ok = F.when(F.col("end") > F.col("start"), F.col("end")).otherwise(F.raise_error(F.lit("an entry of a large object is empty")).cast("long"))
    placed = with_ref_index(entries.withColumn("end", ok) if order == "start" else entries, parent, order, F.col("child.digest"))
    return _collected(placed.withColumn("line", F.concat_ws(" ", "start", "end", F.concat("ref", F.lit("\n"))).cast("binary")), parent)


def encode_tree(entries: DataFrame, parent: str = "parent") -> DataFrame:
    """parent, blob, refs from rows (parent, name, child STRUCT); a commit can't be a child."""
    placed = with_ref_index(entries, parent, "name", F.col("child.digest"))
    kind = F.col("child.kind")
    data = F.concat_ws(" ", "ref", F.lit("data"), "child.size", F.col("child.depth").cast("int"), "name")
    text = F.when(kind.isin("small", "large"), data).when(kind == "tree", F.concat_ws(" ", "ref", F.lit("tree"), "name")).otherwise(F.raise_error(F.lit("a tree holds small, large and tree objects only")))
    return _collected(placed.withColumn("line", F.concat(netstring(text), F.lit(b"\n"))), parent)


def _indexed(children: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Each child's place among the distinct ones, and these."""
    refs = list(dict.fromkeys(children))
    place = {d: i for i, d in enumerate(refs)}
    return [place[d] for d in children], refs


def large_blob(entries: list[dict]) -> tuple[bytes, list[bytes]]:
    """Blob and references of one large object with entries {start, end, child}."""
    entries = sorted(entries, key=lambda e: e["start"])
    if any(e["end"] <= e["start"] for e in entries):
        raise ValueError("an entry of a large object is empty")
    places, refs = _indexed([e["child"]["digest"] for e in entries])
    return b"".join(b"%d %d %d\n" % (e["start"], e["end"], i) for e, i in zip(entries, places, strict=True)), refs


def tree_blob(entries: list[dict]) -> tuple[bytes, list[bytes]]:
    """Blob and references of one tree with entries {name, child}."""
    entries = sorted(entries, key=lambda e: e["name"].encode())
    places, refs = _indexed([e["child"]["digest"] for e in entries])
    out = []
    for e, i in zip(entries, places, strict=True):
        child = e["child"]
        if child["kind"] not in ("small", "large", "tree"):
            raise ValueError("a tree holds small, large and tree objects only")
        body = f"{i} tree {e['name']}" if child["kind"] == "tree" else f"{i} data {child['size']} {child['depth']} {e['name']}"
        out.append(b"%d:%s,\n" % (len(body.encode()), body.encode()))
    return b"".join(out), refs


def decode_large(blob: bytes, refs: list[bytes], size: int, depth: int) -> list[dict]:
    """Entries of a large object; depth 1 has small children."""
    out = []
    for line in blob.split(b"\n")[:-1]:
        start, end, ref = map(int, line.split())
        if ref >= len(refs):
            raise ValueError("an entry refers to no child")
        out.append({"start": start, "end": end, "child": {"kind": "small" if depth <= 1 else "large", "digest": refs[ref], "size": end - start, "depth": max(0, depth - 1)}})
    if (out[-1]["end"] if out else 0) != size:
        raise ValueError("a large object has another size")
    return out


def decode_tree(blob: bytes, refs: list[bytes]) -> list[dict]:
    """Entries of a tree; names may hold anything, since lengths are given."""
    out, at = [], 0
    while at < len(blob):
        data, at = read_netstring(blob, at)
        if blob[at : at + 1] != b"\n":
            raise ValueError("an entry of a tree is not closed")
        at += 1
        ref, kind, rest = data.split(b" ", 2)
        digest = refs[int(ref)]
        if kind == b"tree":
            out.append({"name": rest.decode(), "child": {"kind": "tree", "digest": digest, "size": None, "depth": None}})
        elif kind == b"data":
            size, depth, name = rest.split(b" ", 2)
            out.append({"name": name.decode(), "child": {"kind": "large" if int(depth) else "small", "digest": digest, "size": int(size), "depth": int(depth)}})
        else:
            raise ValueError(f"a tree holds a {kind.decode()}")
    return out


def encode_commit(commit: dict, namespace: str = NAMESPACE) -> tuple[bytes, list[bytes]]:
    """Blob and references of {subtree, parents, seconds, offset_s, name, mbox, message}."""
    triples = [f'_:this <{namespace}commitTimestamp> "{escape_literal(format_rfc2822(commit["seconds"], commit["offset_s"]))}" .\n']
    for key, subject, iri in (("name", "author", f"{FOAF}#term_name"), ("mbox", "author", f"{FOAF}#term_mbox"), ("message", "this", f"{namespace}commitMessage")):
        if commit.get(key) is not None:
            triples.append(f'_:{subject} <{iri}> "{escape_literal(commit[key])}" .\n')
    parents = list(commit.get("parents") or [])
    return f"{len(parents)} 0\n".encode() + b"".join(sorted(t.encode() for t in triples)), [commit["subtree"], *parents]


def decode_commit(blob: bytes, refs: list[bytes], namespace: str = NAMESPACE) -> dict:
    """What ``encode_commit`` was given; unknown subjects are passed over, unknown predicates are errors."""
    head, _, rest = blob.partition(b"\n")
    n_parents, n_meta = map(int, head.split())
    if len(refs) != 1 + n_parents + n_meta:
        raise ValueError("a commit has another number of references")
    out: dict = {"subtree": refs[0], "parents": refs[1 : 1 + n_parents], "seconds": None, "offset_s": None, "name": None, "mbox": None, "message": None}
    known = {("_:author", f"<{FOAF}#term_name>"): "name", ("_:author", f"<{FOAF}#term_mbox>"): "mbox", ("_:this", f"<{namespace}commitMessage>"): "message", ("_:this", f"<{namespace}commitTimestamp>"): "time"}
    for line in rest.decode().splitlines():
        subject, predicate, literal = line.split(" ", 2)
        if subject not in ("_:author", "_:this"):
            continue
        key = known.get((subject, predicate))
        if key is None or not (literal.startswith('"') and literal.endswith('" .')):
            raise ValueError(f"a commit says {line!r}")
        value = unescape_literal(literal[1:-3])
        if key == "time":
            out["seconds"], out["offset_s"] = parse_rfc2822(value)
        else:
            out[key] = value
    if out["seconds"] is None:
        raise ValueError("a commit has no time")
    return out


COMMIT = "struct<subtree: binary, parents: array<binary>, seconds: bigint, offset_s: int, name: string, mbox: string, message: string>"


def decoded_trees(objects: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, child of every entry of the trees in (keys, blob, refs)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(*row[: len(keys)], e["name"], e["child"]) for row in f.itertuples(index=False) for e in decode_tree(row[-2], list(row[-1]))]
            yield pd.DataFrame(rows, columns=[*keys, "name", "child"])

    schema = ", ".join(f"{k} {objects.schema[k].dataType.simpleString()}" for k in keys)
    return objects.select(*keys, "blob", "refs").mapInPandas(run, f"{schema}, name string, child {REF}")


def decoded_larges(objects: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end, child of every entry of the large objects in (keys, size, depth, blob, refs), by SQL alone.

    An object whose entries end elsewhere than at its size is an error, as is an entry of no child.
    """
    listed = F.filter(F.split(F.col("blob").cast("string"), "\n"), lambda x: x != "")
    end_of = F.coalesce(F.split(F.get("_lines", F.size("_lines") - 1), " ")[1].cast("long"), F.lit(0))
    sized = F.when(end_of == F.col("size"), F.col("_lines")).otherwise(F.raise_error(F.lit("a large object has another size")).cast("array<string>"))
    lines = objects.withColumn("_lines", listed).select(*keys, "size", "depth", "refs", F.explode(sized).alias("line"))
    part = F.split("line", " ")
    start, end, ref = (part[i].cast("long") for i in range(3))
    child = F.struct(
        F.when(F.col("depth") <= 1, "small").otherwise("large").alias("kind"),
        F.coalesce(F.get("refs", ref.cast("int")), F.raise_error(F.lit("an entry refers to no child")).cast("binary")).alias("digest"),
        (end - start).alias("size"),
        F.greatest(F.col("depth") - 1, F.lit(0)).cast("smallint").alias("depth"),
    )
    return lines.select(*keys, start.alias("start"), end.alias("end"), child.alias("child"))


def decoded_commits(objects: DataFrame, keys: list[str], namespace: str = NAMESPACE) -> DataFrame:
    """keys and the commit's fields for the commits in (keys, blob, refs)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(*row[: len(keys)], decode_commit(row[-2], list(row[-1]), namespace)) for row in f.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=[*keys, "commit"])

    schema = ", ".join(f"{k} {objects.schema[k].dataType.simpleString()}" for k in keys)
    return objects.select(*keys, "blob", "refs").mapInPandas(run, f"{schema}, commit {COMMIT}").select(*keys, "commit.*")
