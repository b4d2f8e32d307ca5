"""Adjustment against the average of a group, and career totals."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from almanac.functions.aggregates import group_rate, weighted_mean
from almanac.operators.joins import attach_stats, null_safe_join
from almanac.operators.settle import settle


def _with_group_stats(df: DataFrame, by: list[str], stats: list[Column]) -> DataFrame:
    """Attach per-group statistics to every row.

    The statistics come from a partial and a final aggregate, so a hot group costs no more
    than others. They are settled first: Spark then knows how small they are and broadcasts
    them if they fit, which leaves the rows of ``df`` where they are.
    """
    return null_safe_join(df, settle(df.groupBy(*by).agg(*stats)), by)


def index_to_mean(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """Add ``<col>_plus``: the value as a percentage of the mean of its group."""
    out = _with_group_stats(df, by, [F.avg(c).alias(f"_{c}_mean") for c in cols])
    return out.withColumns(
        {f"{c}_plus": F.try_divide(100 * F.col(c), F.col(f"_{c}_mean")) for c in cols}
    ).drop(*[f"_{c}_mean" for c in cols])


def index_to_rate(df: DataFrame, rates: dict[str, tuple[str, ...]], by: list[str]) -> DataFrame:
    """Add, per entry ``name: (num, den)``, the rate as a percentage of the rate of its group.

    A third column name in the entry is the numerator of the group's rate, if that is another one.
    """
    out = _with_group_stats(
        df, by, [group_rate(F.col(spec[-1] if len(spec) > 2 else spec[0]), F.col(spec[1])).alias(f"_{name}")
                 for name, spec in rates.items()]
    )
    return out.withColumns(
        {
            name: F.try_divide(100 * F.try_divide(F.col(spec[0]), F.col(spec[1])), F.col(f"_{name}"))
            for name, spec in rates.items()
        }
    ).drop(*[f"_{name}" for name in rates])


def above_average(df: DataFrame, rates: dict[str, tuple[str, str]], by: list[str]) -> DataFrame:
    """Add, per entry ``name: (num, den)``, the amount above what the rate of the group would give.

    That is ``(num / den - group rate) * den``; null where ``den`` is 0.
    """
    out = _with_group_stats(
        df, by, [group_rate(F.col(n), F.col(d)).alias(f"_{name}") for name, (n, d) in rates.items()]
    )
    return out.withColumns(
        {
            name: (F.try_divide(F.col(n), F.col(d)) - F.col(f"_{name}")) * F.col(d)
            for name, (n, d) in rates.items()
        }
    ).drop(*[f"_{name}" for name in rates])


def career_rollup(
    df: DataFrame, keys: list[str], sums: list[str], weighted: dict[str, str]
) -> DataFrame:
    """Totals of ``sums`` and means of ``weighted`` (``column: weight column``) per entity, in one pass."""
    return df.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums],
        *[weighted_mean(F.col(c), F.col(w)).alias(c) for c, w in weighted.items()],
    )


def weighted_composite(scaled: DataFrame, parts: dict[str, list[str]], weights: DataFrame) -> DataFrame:
    """Add, per entry ``name: columns``, the mean of the columns weighted by their ``r_squared``.

    ``weights`` is a long table with ``variable`` and ``r_squared``, as ``correlation_screen`` gives.
    """
    used = sorted({c for cols in parts.values() for c in cols})
    row = weights.agg(
        *[F.max(F.when(F.col("variable") == c, F.col("r_squared"))).alias(f"_{c}_w") for c in used]
    )
    out = attach_stats(scaled, row)
    return out.withColumns(
        {
            name: F.try_divide(
                reduce(add, [F.col(c) * F.col(f"_{c}_w") for c in cols]),
                reduce(add, [F.col(f"_{c}_w") for c in cols]),
            )
            for name, cols in parts.items()
        }
    ).drop(*[f"_{c}_w" for c in used])
