"""Operators on row identity: first rows, repeated keys, pairing, replacing, stacking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from almanac.functions.scalars import number, prefix_match
from almanac.operators.joins import matching_rows, null_safe_join
from almanac.operators.numbering import row_numbers
from almanac.operators.settle import settle


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key. Spark cuts each map task to ``n`` per key before it shuffles."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(window)).where(F.col("_place") <= n).drop("_place")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``."""
    return first_n(df, keys, order, 1)


def first_by(df: DataFrame, keys: list[str], col: str, order: Column) -> DataFrame:
    """The value of ``col`` in the first row of each group."""
    return df.groupBy(*keys).agg(F.min_by(col, order).alias(col))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once; missing keys count as equal."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    return matching_rows(df, repeated, keys, "left_semi")


def replace_groups(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Drop the groups of ``base`` that ``new`` holds, then add the rows of ``new``."""
    kept = matching_rows(base, new.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new)


def union_all(frames: list[DataFrame | None]) -> DataFrame:
    """Stack frames by column name; absent frames are skipped and absent columns are null."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [f for f in frames if f is not None]
    )


def split_rows(df: DataFrame, weights: list[float], seed: int, keys: list[str] | None = None) -> list[DataFrame]:
    """Split the rows at random with the given probabilities, by a hash of their ``keys`` (all columns by default) and the seed.

    The side of a row follows from its keys alone: it survives other partitions, other rows and a second
    run, and rows with equal keys stay together. Every row is on exactly one side.
    """
    if not weights or any(w < 0 for w in weights) or sum(weights) <= 0:
        raise ValueError("weights are not negative, and not all 0")
    # 53 bits of the hash, as a number from 0 up to 1.
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in keys or df.columns]), 11) / F.lit(float(1 << 53))
    ends = [sum(weights[: i + 1]) / sum(weights) for i in range(len(weights))]
    ends[-1] = 1.0
    return [df.where((place >= start) & (place < end)) for start, end in zip([0.0, *ends], ends)]


def numeric_rows(
    df: DataFrame, col: str, low: float, high: float | None = None, counted: Observation | None = None
) -> DataFrame:
    """Rows whose text casts to a number above ``low`` (and below ``high``): drops repeated headers.

    ``counted`` takes the numbers ``asked`` and ``skipped`` of rows from the pass that first computes the result.
    """
    value = number(F.col(col))
    kept = value > low if high is None else (value > low) & (value < high)
    if counted is not None:
        kept = F.coalesce(kept, F.lit(False))
        df = df.observe(counted, F.count("*").alias("asked"), F.count_if(~kept).alias("skipped"))
    return df.where(kept)


def rule_filter(df: DataFrame, when: Column, then: Column, otherwise: Column) -> DataFrame:
    """Filter by one predicate where ``when`` holds and by another elsewhere."""
    return df.where(F.when(when, then).otherwise(otherwise))


def zip_rows(a: DataFrame, b: DataFrame, key: str, order_a: str, order_b: str) -> DataFrame:
    """Pair the first row of ``a`` with the first of ``b`` per key, the second with the second, ...

    Rows without a partner are dropped. An order column with the same name on both sides is kept once.
    """
    left = row_numbers(a, [key], [order_a], "_place")
    right = row_numbers(b, [key], [order_b], "_place")
    if order_b in a.columns:
        right = right.drop(order_b)
    return null_safe_join(left, right, [key, "_place"]).drop("_place")


def match_by_name(
    a: DataFrame, b: DataFrame, keys: list[str], tiebreak: str, prefix: int = 4
) -> DataFrame:
    """Left join of two record lists that know each other only by name.

    Rows of ``a`` that share their keys match on keys and ``tiebreak`` together. The others match
    on the keys; where several rows of ``b`` have those keys, the ones whose ``tiebreak`` starts
    with the same ``prefix`` characters win, and all of them stay if none does. The result has
    the columns of ``a`` followed by those of ``b`` it does not share.
    """
    extra = [c for c in b.columns if c not in a.columns]
    shared = a.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    doubtful = matching_rows(a, shared, keys, "left_semi")
    clear = matching_rows(a, shared, keys, "left_anti")

    by_tiebreak = null_safe_join(doubtful, b.select(*keys, tiebreak, *extra), [*keys, tiebreak], "left")

    offered = null_safe_join(
        clear, b.select(*keys, F.col(tiebreak).alias("_other"), *extra), keys, "left"
    ).withColumn("_agrees", F.coalesce(prefix_match(F.col(tiebreak), F.col("_other"), prefix), F.lit(False)))
    # Read twice below; the join runs once.
    offered = settle(offered)
    verdict = offered.groupBy(*keys).agg(
        F.count("*").alias("_offers"), F.max("_agrees").alias("_settled")
    )
    by_name = (
        null_safe_join(offered, verdict, keys)
        .where((F.col("_offers") == 1) | F.col("_agrees") | ~F.col("_settled"))
    )
    columns = [*a.columns, *extra]
    return by_tiebreak.select(*columns).unionByName(by_name.select(*columns))
