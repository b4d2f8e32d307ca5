"""From raw season tables to adjusted season tables, and from careers to projections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from almanac.functions.aggregates import strict_sum
from almanac.operators.joins import attach_stats, matching_rows, null_safe_join
from almanac.operators.rates import above_average, index_to_rate
from almanac.operators.settle import settle


def adjusted_stats(
    stats: DataFrame,
    standings: DataFrame,
    period: str,
    keys: list[str],
    amounts: dict[str, tuple[str, str]] | None = None,
    indexes: dict[str, tuple[str, ...]] | None = None,
) -> DataFrame:
    """Adjust a season table against its periods, then join the standings on ``keys``.

    ``amounts`` become amounts above average, ``indexes`` percentages of the average rate.
    """
    out = stats
    if amounts:
        out = above_average(out, amounts, [period])
    if indexes:
        out = index_to_rate(out, indexes, [period])
    return null_safe_join(out, standings, keys)


def player_table(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Add a second family of statistics to a player table; players without one keep nulls."""
    return null_safe_join(first, second, keys, "left")


def cohort_projection(
    facts: DataFrame,
    cohorts: DataFrame,
    entity: str,
    period: str,
    value: str,
    start: str,
    horizon: int,
    as_of: int,
    train_until: int,
    leave_out: tuple = (),
) -> DataFrame:
    """Value of every entity over its first ``horizon`` periods, projected where they are not over.

    ``facts`` holds ``value`` per entity and ``period``; ``cohorts`` the ``start`` of each entity. Cohorts up
    to ``train_until`` are finished: they get their sum and teach, for each N below the horizon, how the
    rest follows from the first N periods. A cohort with N periods up to ``as_of`` gets what it has plus
    the rest that predicts. An entity with several starts has a value for each. Without a fact up to the end of the horizon, or with a
    missing one, the value is null. Entities in ``leave_out`` teach nothing and get null.
    """
    single = cohorts.select(entity, F.col(start).alias("_start")).distinct()
    if leave_out:
        single = single.where(~F.col(entity).isin(*leave_out))
    # Facts shrink to one row per entity and period before they meet the cohorts.
    yearly = facts.groupBy(entity, F.col(period).alias("_period")).agg(
        F.count_if(F.col(value).isNull()).alias("_gaps"), strict_sum(F.col(value)).alias("_value")
    )
    yearly = yearly.join(single, entity)
    age = F.col("_period") - F.col("_start")
    steps = range(1, horizon)
    # Read twice below, to learn and to apply; one row per entity.
    totals = settle(yearly.groupBy(entity, "_start").agg(
        *[strict_sum(F.col("_value"), age < n).alias(f"_known_{n}") for n in steps],
        *[strict_sum(F.col("_value"), age.between(n, horizon - 1)).alias(f"_rest_{n}") for n in steps],
        F.when(F.count_if(age < horizon) > 0, strict_sum(F.col("_value"), age < horizon)).alias("_whole"),
        strict_sum(F.col("_value"), F.col("_period") <= as_of).alias("_so_far"),
        F.count_if(F.col("_period") <= as_of).alias("_seen"),
    ))
    lines = totals.where(F.col("_start") <= train_until).agg(
        *[F.regr_slope(f"_rest_{n}", f"_known_{n}").alias(f"_slope_{n}") for n in steps],
        *[F.regr_intercept(f"_rest_{n}", f"_known_{n}").alias(f"_base_{n}") for n in steps],
    )
    projected = F.when(F.col("_start") <= train_until, F.col("_whole").cast("double"))
    for n in steps:
        of_cohort = (F.col("_start") == as_of + 1 - n) & (F.col("_seen") > 0)
        estimate = F.col("_so_far") + F.col(f"_base_{n}") + F.col(f"_slope_{n}") * F.col("_so_far")
        projected = projected.when(of_cohort, estimate)
    values = attach_stats(totals, lines).select(entity, F.col("_start").alias(start), projected.alias(value))
    return null_safe_join(cohorts, values, [entity, start], "left").select(*cohorts.columns, value)


def backfill(
    master: DataFrame, facts: DataFrame, key: str, fetch: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Add the rows ``fetch`` finds for the entities of ``master`` that ``facts`` does not know."""
    missing = matching_rows(master, facts.select(key).distinct(), [key], "left_anti")
    return facts.unionByName(fetch(missing), allowMissingColumns=True)
