"""Every query that has SQL against DuckDB, as the driver compares them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(r[i] for i in order) for r in data], key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same(spark, db, name):
    found = entry.queries()[name](spark, SF)
    want = db.sql(SQL[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found.columns, map(tuple, found.collect())) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
