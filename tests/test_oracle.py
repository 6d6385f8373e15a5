"""t1: the flagship entry runs; t2: every registered query agrees with its
DuckDB oracle (row count, column names, values) on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF001
from scripts.oracle_check import rows_of
from wordloom.session import TABLES

QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1 and set(df.columns) == {"lang", "n_docs", "n_tokens", "n_truncated", "max_body"}


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF001)
    srows = [r.asDict(recursive=True) for r in sdf.collect()]
    if name not in SQL:
        assert len(srows) > 0
        return
    rel = con.sql(SQL[name])
    drows = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    assert sorted(sdf.columns) == sorted(rel.columns)
    cols = sorted(sdf.columns)
    assert rows_of(srows, cols) == rows_of(drows, cols)
