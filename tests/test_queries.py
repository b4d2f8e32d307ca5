"""Every query on the smallest tables against its SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
    else:
        result = db.sql(sql)
        assert compare(rows, df.columns, result.fetchall(), result.columns) == ""


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["order_year", "o_custkey", "quantity", "price_plus"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
