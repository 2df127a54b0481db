"""The queries with SQL give the rows that DuckDB gives, on the smallest tables and on plain edge cases."""

import duckdb
import pytest

from siltstone.llm import decontamination, minhash, oracles
from siltstone.llm.queries import ORACLES, QUERIES


def compare(duck, sql, df):
    columns = sorted(df.columns)
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == want
    return want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, data, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    assert compare(duck, ORACLES[name], QUERIES[name](spark, data))


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(40))
    texts = [None, "", " \t\n", "one two", "ONE  two", "one two three", long, long.replace("w39", "x"), long.upper(), long + " " + long, "a b " + long + " c", "two one two three x", "éÉ 　z"]
    items = [None, "", "one two", long, long.replace("w20", "y"), "nothing of the kind is here at all"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    duck = duckdb.connect()
    for name, column, rows in (("documents", "doc_id", texts), ("benchmark", "item_id", items)):
        duck.execute(f"CREATE TABLE {name} ({column} BIGINT, text VARCHAR)")
        duck.executemany(f"INSERT INTO {name} VALUES (?, ?)", list(enumerate(rows)))
    assert compare(duck, oracles.near_duplicates(85, 100), minhash.near_duplicates(docs, 85, 100))
    assert compare(duck, oracles.contamination(0.8), decontamination.matches(docs, benchmark))
