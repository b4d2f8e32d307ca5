"""Joins with the semantics statistical scripts expect: missing keys match each other."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F


def _name(side: str, name: str) -> Column:
    return F.col(f"{side}.`{name}`")


def _same(keys: list[str]) -> Column:
    return reduce(and_, [_name("a", k).eqNullSafe(_name("b", k)) for k in keys])


def null_safe_join(
    a: DataFrame,
    b: DataFrame,
    keys: list[str],
    how: str = "inner",
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Inner or left join on ``keys`` where a missing key equals a missing key.

    Other columns present on both sides keep both copies, told apart by ``suffixes``.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is 'inner' or 'left'")
    left = [c for c in a.columns if c not in keys]
    right = [c for c in b.columns if c not in keys]
    clash = set(left) & set(right)
    out = [_name("a", k).alias(k) for k in keys]
    out += [_name("a", c).alias(c + suffixes[0] if c in clash else c) for c in left]
    out += [_name("b", c).alias(c + suffixes[1] if c in clash else c) for c in right]
    return a.alias("a").join(b.alias("b"), _same(keys), how).select(*out)


def join_prefer_left(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``null_safe_join`` that keeps only the left copy of a column present on both sides."""
    extra = [c for c in b.columns if c in keys or c not in a.columns]
    return null_safe_join(a, b.select(*extra), keys, how)


def matching_rows(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Rows of ``a`` with (``left_semi``) or without (``left_anti``) a null-safe match in ``b``."""
    return a.alias("a").join(b.select(*keys).alias("b"), _same(keys), how)


def subtract_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` with no equal row in ``b`` over all the columns they share.

    Repeated rows of ``a`` stay repeated, unlike ``EXCEPT``.
    """
    common = [c for c in a.columns if c in b.columns]
    return matching_rows(a, b.select(*common).distinct(), common, "left_anti")


def attach_stats(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row table next to every row of ``df``.

    The row is computed now and becomes constants of the plan, as with a fitted model: no join and
    no shuffle. A table of two rows is an error, an empty one gives nulls.
    """
    found = one_row.limit(2).collect()
    if len(found) > 1:
        raise ValueError("the table of statistics has more than one row")
    values = found[0] if found else [None] * len(one_row.columns)
    return df.withColumns(
        {f.name: F.lit(value).cast(f.dataType) for f, value in zip(one_row.schema.fields, values)}
    )
