"""The registered queries that have SQL give the same rows as DuckDB on the smallest tables."""

import os

import pytest

from tessella.plans import catalog, sql

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def compare(df, relation):
    assert sorted(df.columns) == sorted(relation.columns)
    order = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    at = [relation.columns.index(c) for c in order]
    assert rows == sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=repr)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(sql.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, tables, name):
    compare(catalog.queries()[name](spark, DATA), tables.sql(sql.oracle_sql()[name]))


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.queries()) >= set(catalog.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
