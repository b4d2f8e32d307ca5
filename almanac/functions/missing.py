"""Missing values. Null and NaN both count as missing."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T

_FLOATING = (T.DoubleType, T.FloatType)


def present(col: Column) -> Column:
    """A floating point column with NaN turned into null."""
    return F.when(~F.isnan(col), col)


def is_missing(df: DataFrame, name: str) -> Column:
    """True where the named column is null or NaN."""
    col = F.col(name)
    if isinstance(df.schema[name].dataType, _FLOATING):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def none_missing(df: DataFrame, names: list[str]) -> Column:
    """True where all the named columns hold a value."""
    return reduce(and_, [~is_missing(df, name) for name in names])


def clear_missing(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Set every missing value of the numeric columns (all of them by default) to 0."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return df.fillna(0, subset=cols)
