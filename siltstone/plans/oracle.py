"""Building blocks of DuckDB SQL that state the same results as the Spark queries."""

from __future__ import annotations

HASH = "SHA-2-256"


def leb(n: str) -> str:
    """LEB128 of a number below 2^28, as a blob."""
    byte = lambda shift, more: f"unhex(printf('%02x', ((({n}) >> {shift}) & 127) + {128 if more else 0}))"
    cases = []
    for groups in (1, 2, 3, 4):
        parts = " || ".join(byte(7 * i, i < groups - 1) for i in range(groups))
        cases.append(f"WHEN ({n}) < {1 << 7 * groups} THEN {parts}")
    return f"(CASE {' '.join(cases)} END)"


def digest(blob: str, refs_hex: str = "''") -> str:
    """The hexadecimal digest of an object with a blob and its references' digits side by side."""
    count = f"(length({refs_hex}) // 64)::BIGINT"
    return f"sha256(encode('{HASH}') || unhex('00') || {leb('32')} || {leb(f'octet_length({blob})::BIGINT')} || {leb(count)} || unhex('00') || unhex(sha256({blob})) || unhex({refs_hex}))"


def bytes_of(source: str, p: str = "") -> str:
    """CTEs up to {p}b (id, pos from 1, v) over a CTE ``source`` (id, blob)."""
    return f"""{p}hexed AS (SELECT id, regexp_extract_all(hex(blob), '..') AS l FROM {source}),
{p}places AS (SELECT id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS pos FROM {p}hexed),
{p}b AS (SELECT id, pos, (instr('123456789ABCDEF', x[1]) * 16 + instr('123456789ABCDEF', x[2]))::BIGINT AS v FROM {p}places)"""


def cuts_of(source: str, window: int, log2: int, marker: int, before: bool = False, p: str = "") -> str:
    """CTEs up to {p}ranges (id, ordinal, s, e) of the chunks of ``source``, a last empty one left out beside others."""
    at = "pos - 1" if before else "pos"
    return f"""{bytes_of(source, p)},
{p}sums AS (SELECT id, pos, sum(v) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS t FROM {p}b),
{p}ends AS (SELECT id, list({at} ORDER BY pos) AS l FROM {p}sums WHERE pos >= {window} AND t % {1 << log2} = {marker} GROUP BY id),
{p}cuts AS (SELECT id, list_reduce(list_transform(l, lambda e: [e]), lambda a, x: CASE WHEN x[1] - a[-1] >= {window} THEN list_concat(a, x) ELSE a END, [0::BIGINT]) AS c FROM {p}ends),
{p}lists AS (SELECT s.id, octet_length(s.blob)::BIGINT AS n, coalesce(c.c, [0::BIGINT]) AS c FROM {source} s LEFT JOIN {p}cuts c USING (id)),
{p}pieces AS (SELECT id, n, unnest(range(0, len(c))) AS ordinal, unnest(c) AS s, unnest(list_concat(c[2:], [n])) AS e FROM {p}lists),
{p}ranges AS (SELECT id, ordinal::INTEGER AS ordinal, s, e FROM {p}pieces WHERE e > s OR ordinal = 0)"""


#: The two snapshots of documents that diffs and batches compare.
SNAPSHOT_A = "SELECT doc_id AS id, lang, source, encode(text) AS blob FROM documents"
SNAPSHOT_B = """SELECT doc_id AS id, lang, source, encode(CASE WHEN source = 'src3' THEN text || '!' ELSE text END) AS blob FROM documents WHERE source <> 'src7'
UNION ALL SELECT doc_id + 1000000, lang, source, encode(text) FROM documents WHERE source = 'src5'"""


def objects_of(snapshot: str, prefix: str = "") -> str:
    """CTEs up to ``{prefix}tree`` (path, parent, name, kind, digest, size) with leaves as small objects, and directories above."""
    p = prefix
    line = lambda text: f"printf('%d:%s,', octet_length(encode({text})), {text}) || chr(10)"
    level = lambda name, source, parent, child: f"""{p}{name}_first AS (SELECT *, min(name) OVER (PARTITION BY {parent}, digest) AS f FROM {p}{source}),
{p}{name}_ref AS (SELECT *, dense_rank() OVER (PARTITION BY {parent} ORDER BY f) - 1 AS r FROM {p}{name}_first),
{p}{name}_text AS (SELECT {parent}, string_agg({line(child)}, '' ORDER BY name) AS t FROM {p}{name}_ref GROUP BY {parent}),
{p}{name}_refs AS (SELECT {parent}, string_agg(digest, '' ORDER BY r) AS refs FROM (SELECT DISTINCT {parent}, r, digest FROM {p}{name}_ref) GROUP BY {parent})"""  # noqa: E731
    data = "r || ' data ' || size || ' 0 ' || name"
    tree = "r || ' tree ' || name"
    return f"""{p}snap AS ({snapshot}),
{p}leaf AS (SELECT lang, source, 'doc_' || id AS name, id, octet_length(blob)::BIGINT AS size, {digest('blob')} AS digest FROM {p}snap),
{level('a', 'leaf', 'lang, source', data)},
{p}dirs AS (SELECT lang, source AS name, {digest('encode(t)', 'refs')} AS digest FROM {p}a_text JOIN {p}a_refs USING (lang, source)),
{level('b', 'dirs', 'lang', tree)},
{p}langs AS (SELECT 1 AS top, lang AS name, {digest('encode(t)', 'refs')} AS digest FROM {p}b_text JOIN {p}b_refs USING (lang)),
{level('c', 'langs', 'top', tree)},
{p}root AS (SELECT {digest('encode(t)', 'refs')} AS digest FROM {p}c_text JOIN {p}c_refs USING (top)),
{p}tree AS (SELECT lang || '/' || source || '/' || name AS path, lang || '/' || source AS parent, name, 'small' AS kind, digest, size FROM {p}leaf
  UNION ALL SELECT lang || '/' || name, lang, name, 'tree', digest, NULL FROM {p}dirs
  UNION ALL SELECT name, '', name, 'tree', digest, NULL FROM {p}langs)"""
