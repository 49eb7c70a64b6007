"""Every registered query with a SQL counterpart gives the same rows on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from scripts.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    df = QUERIES[key](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if key not in ORACLES:
        assert df.columns
        return
    cur = con.execute(ORACLES[key])
    want = cur.fetchall()
    assert rows_of(df.columns, got) == rows_of([d[0] for d in cur.description], want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
