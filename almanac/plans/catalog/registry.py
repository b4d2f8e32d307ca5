"""Registry of the queries on the test tables and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The test tables of one folder, read when first used."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder.rstrip('/')}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query on the tables, with the SQL that must give the same rows if there is one."""

    def add(build: Callable[[Tables], DataFrame]):
        QUERIES[build.__name__] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return add


def rounded(col: Column | str, places: int) -> Column:
    return F.round(col, places)


def r(expression: str, places: int) -> str:
    """SQL rounding that never gives a negative zero."""
    return f"(round({expression}, {places}) + 0.0)"
