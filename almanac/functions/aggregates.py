"""Aggregate expressions; each has a map-side partial form."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strict_sum(col: Column, cond: Column | None = None) -> Column:
    """A sum that is null as soon as one input is null, and 0 when there is no input.

    With ``cond`` only the rows that meet it are inputs.
    """
    inside = F.lit(True) if cond is None else F.coalesce(cond, F.lit(False))
    gaps = F.count_if(inside & col.isNull())
    return F.when(gaps == 0, F.coalesce(F.sum(F.when(inside, col)), F.lit(0)))


def weighted_mean(x: Column, weight: Column) -> Column:
    """``sum(x * weight) / sum(weight)`` over the rows that have ``x``; null when their weights add up to 0."""
    return F.try_divide(F.sum(x * weight), F.sum(F.when(x.isNotNull(), weight)))


def group_rate(num: Column, den: Column) -> Column:
    """Rate of totals; null when the total of the denominator is 0."""
    return F.try_divide(F.sum(num), F.sum(den))
