"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from wayloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.execute(catalog.ORACLE_SQL[name])
    order = [[d[0] for d in want.description].index(c) for c in columns]
    rows = [tuple(r[i] for i in order) for r in want.fetchall()]
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, rows))


def test_entry_imports():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
