"""Every query with SQL gives the same rows, columns and types of value as DuckDB."""

import os

import duckdb
import pytest
from tidemark.queries import reference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def norm(row):
    return tuple(str(round(x, 12)) if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(reference.SQL))
def test_agrees_with_sql(spark, con, name):
    df = reference.QUERIES[name](spark, SF)
    rel = con.sql(reference.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got = sorted(norm(r) for r in df.select(*rel.columns).collect())
    assert got == sorted(norm(r) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
