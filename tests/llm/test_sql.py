"""The queries with SQL give DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from wayloom.llm import queries

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.execute(queries.ORACLE_SQL[name])
    order = [[d[0] for d in want.description].index(c) for c in columns]
    rows = [tuple(r[i] for i in order) for r in want.fetchall()]
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, rows))
