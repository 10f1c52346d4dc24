"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import __spark_entry__ as entry
import duckdb
import pytest
from docsift.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    r = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    assert got == sorted(tuple(plain(row[i]) for i in at) for row in r.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "file_level" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
