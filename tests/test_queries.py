"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import math

import duckdb
import pytest

from siltstone.plans.repository_queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return f"{v:.6f}"
    return v.hex() if isinstance(v, bytes | bytearray) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())
    assert got == want


def test_large_hierarchy_of_empty_and_missing_texts(spark, tmp_path):
    words = [(i, "".join(chr(97 + (i * k * k + k) % 26) for k in range(i * 40)), ("en", "de", None)[i % 3]) for i in range(60)]
    rows = words + [(100 + i, "", "en") for i in range(20)] + [(200, None, "de"), (201, "", "one"), (202, None, "none"), (None, "no id", "en")] + [(300 + i, "", "few") for i in range(17)]
    spark.createDataFrame([(i, t, lang, "s") for i, t, lang in rows], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(plain(v) for v in r) for r in QUERIES["large_hierarchy"](spark, str(tmp_path)).collect())
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(tuple(plain(v) for v in r) for r in duck.execute(ORACLES["large_hierarchy"]).fetchall())
