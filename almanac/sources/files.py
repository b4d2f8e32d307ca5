"""File readers and writers. Every reader takes its schema; nothing is guessed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from almanac.operators.settle import settle

# Fixed value: the text that stands for a missing value in CSV files.
MISSING = "NA"

_REJECTED = "_rejected_line"


def _stats_csv(spark: SparkSession, path: str, schema: str | T.StructType, header: bool, **options) -> DataFrame:
    return spark.read.csv(
        path, schema=schema, header=header, nullValue=MISSING, ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True, enforceSchema=True, timestampFormat="yyyy-MM-dd HH:mm:ss", **options,
    )


def read_stats_csv(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True) -> DataFrame:
    """CSV with a header, ``NA`` for missing values and numbers that may be padded with spaces."""
    return _stats_csv(spark, path, schema, header)


def read_checked_csv(
    spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True
) -> tuple[DataFrame, DataFrame]:
    """``read_stats_csv`` as the rows that fit the schema, and the lines that do not, in the column ``line``.

    A line is rejected when it has fewer or more fields than the schema, or a field that is no value of its type. The
    files are parsed once, into a table that holds both.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = [f"`{f.name}`" for f in kind.fields]
    whole = T.StructType([*kind.fields, T.StructField(_REJECTED, T.StringType())])
    parsed = settle(_stats_csv(spark, path, whole, header, mode="PERMISSIVE", columnNameOfCorruptRecord=_REJECTED))
    good = parsed.where(f"{_REJECTED} is null").select(*names)
    return good, parsed.where(f"{_REJECTED} is not null").selectExpr(f"{_REJECTED} as line")


def write_stats_csv(df: DataFrame, path: str) -> None:
    """Write CSV with a header and ``NA`` for missing values, replacing what was there."""
    df.write.mode("overwrite").csv(
        path, header=True, nullValue=MISSING, emptyValue='""', timestampFormat="yyyy-MM-dd HH:mm:ss"
    )


def read_json_records(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON records, one per line; only the fields of the schema are read, cast to its types."""
    return spark.read.json(path, schema=schema)


def read_snapshot(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A stored copy of a packaged data set: Parquet, or CSV if the path ends in ``.csv``."""
    if path.rstrip("/").endswith(".csv"):
        return read_stats_csv(spark, path, schema)
    return spark.read.schema(schema).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Write Parquet partitioned by ``by``; only the partitions that occur in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
