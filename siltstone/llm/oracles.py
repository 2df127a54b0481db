"""DuckDB SQL for the operators whose results SQL can express, by plain exact comparison."""

from __future__ import annotations


def shingles(source: str) -> str:
    """CTEs up to ``shingles`` (kind, id, n, pos, v) of ``source`` (kind, id, text): n words, five from each position on, all at 0 if fewer."""
    return rf"""worded AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {source}),
placed AS (SELECT kind, id, len(w) AS n, unnest(range(len(w))) AS pos, unnest(w) AS x FROM worded),
joined AS (SELECT kind, id, n, pos, concat_ws(' ', x, {", ".join(f"lead(x, {i}) OVER ahead" for i in range(1, 5))}) AS v FROM placed WINDOW ahead AS (PARTITION BY kind, id ORDER BY pos)),
shingles AS (SELECT * FROM joined WHERE pos <= greatest(0, n - 5))"""


def near_duplicates(num: int, den: int) -> str:
    """One row per document; sets are compared that share one of the shingles that a link cannot do without, rarest first."""
    return f"""WITH RECURSIVE texts AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents),
{shingles("texts")},
sets AS (SELECT id AS doc_id, list_sort(list(DISTINCT v)) AS s FROM shingles GROUP BY id),
classes AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM sets GROUP BY s),
postings AS (SELECT rep, n, unnest(s) AS v FROM classes),
counted AS (SELECT *, count(*) OVER (PARTITION BY v) AS f FROM postings),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY f, v) AS place FROM counted),
needed AS (SELECT rep, n, v FROM ranked WHERE place <= n - ({num} * n + {den - 1}) // {den} + 1 AND f > 1),
pairs AS (SELECT DISTINCT p.rep AS a, q.rep AS b FROM needed p JOIN needed q ON p.v = q.v AND p.rep < q.rep AND {den} * least(p.n, q.n) >= {num} * greatest(p.n, q.n)),
shared AS (SELECT a, b, x.n AS m, y.n AS n, len(list_intersect(x.s, y.s)) AS i FROM pairs JOIN classes x ON x.rep = a JOIN classes y ON y.rep = b),
links AS (SELECT a, b FROM shared WHERE {den} * i >= {num} * (m + n - i)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, found) AS (SELECT rep, rep FROM classes UNION SELECT e.b, r.found FROM reach r JOIN edges e ON e.a = r.node),
components AS (SELECT node, min(found) AS component FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(len(s.s), 0)::BIGINT AS n_shingles, coalesce(k.component, d.doc_id) AS component_id, d.doc_id = coalesce(k.component, d.doc_id) AS kept
FROM documents d LEFT JOIN sets s USING (doc_id) LEFT JOIN classes c ON c.s = s.s LEFT JOIN components k ON k.node = c.rep"""


def contamination(threshold: float) -> str:
    """The best window of each item in each document, over all windows that share a shingle with the item."""
    return f"""WITH texts AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
{shingles("texts")},
weighed AS (SELECT *, octet_length(encode(v)) - least(n, 5) + 1 AS u FROM shingles),
items AS (SELECT id AS item_id, n AS size, v, u, count(*) AS c FROM weighed WHERE kind = 'i' GROUP BY ALL),
item_weight AS (SELECT item_id, sum(u * c)::BIGINT AS total FROM items GROUP BY item_id),
docs AS (SELECT id AS doc_id, n, pos, v, u, sum(u) OVER (PARTITION BY id ORDER BY pos) AS upto FROM weighed WHERE kind = 'd'),
hits AS (SELECT d.doc_id, d.n, d.pos, d.v, d.u, i.item_id, i.size, i.c, greatest(1, least(d.n, i.size) - 4) AS m FROM docs d JOIN items i USING (v) WHERE i.size >= 5 AND d.n >= 5 OR i.size = d.n),
starts AS (SELECT *, unnest(range(greatest(0, pos - m + 1), least(pos, greatest(0, n - 5) + 1 - m) + 1)) AS start FROM hits),
common AS (SELECT doc_id, item_id, n, size, m, start, v, u * least(c, count(*)) AS low FROM starts GROUP BY doc_id, item_id, n, size, m, start, v, u, c),
summed AS (SELECT doc_id, item_id, n, size, m, start, sum(low)::BIGINT AS low FROM common GROUP BY doc_id, item_id, n, size, m, start),
scored AS (SELECT s.doc_id, s.item_id, s.start, least(s.n, s.size) AS n_words, s.low / (b.upto - a.upto + a.u + w.total - s.low)::BIGINT AS similarity
  FROM summed s JOIN item_weight w USING (item_id) JOIN docs a ON a.doc_id = s.doc_id AND a.pos = s.start JOIN docs b ON b.doc_id = s.doc_id AND b.pos = s.start + s.m - 1),
short AS (SELECT d.id AS doc_id, i.id AS item_id, len(i.w) AS n_words, list_filter(range(len(d.w) - len(i.w) + 1), lambda p: d.w[p + 1:p + len(i.w)] = i.w) AS at_words
  FROM worded i JOIN worded d ON i.kind = 'i' AND d.kind = 'd' AND len(i.w) BETWEEN 1 AND 4 AND len(d.w) > len(i.w)),
found AS (SELECT * FROM scored WHERE similarity >= {threshold} UNION ALL SELECT doc_id, item_id, at_words[1], n_words, 1 FROM short WHERE len(at_words) > 0)
SELECT doc_id, item_id, start::BIGINT AS start_word, n_words::BIGINT AS n_words, similarity::DOUBLE AS similarity FROM found
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1"""
