"""Column statistics, least squares, scaling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from almanac.functions.missing import none_missing
from almanac.functions.scalars import min_max, z_score
from almanac.operators.joins import attach_stats


def column_ranges(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row with ``<col>_min`` and ``<col>_max`` for every column."""
    return df.agg(
        *[F.min(c).alias(f"{c}_min") for c in cols], *[F.max(c).alias(f"{c}_max") for c in cols]
    )


def column_spread(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row with ``<col>_mean`` and ``<col>_sd`` (sample standard deviation) for every column."""
    return df.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in cols], *[F.stddev_samp(c).alias(f"{c}_sd") for c in cols]
    )


def scale_min_max(df: DataFrame, cols: list[str]) -> DataFrame:
    """Replace the columns by their place between the smallest and the largest value."""
    out = attach_stats(df, column_ranges(df, cols))
    return out.withColumns(
        {c: min_max(F.col(c), F.col(f"{c}_min"), F.col(f"{c}_max")) for c in cols}
    ).select(*df.columns)


def scale_z(df: DataFrame, cols: list[str]) -> DataFrame:
    """Replace the columns by their distance from the mean in standard deviations."""
    out = attach_stats(df, column_spread(df, cols))
    return out.withColumns(
        {c: z_score(F.col(c), F.col(f"{c}_mean"), F.col(f"{c}_sd")) for c in cols}
    ).select(*df.columns)


def correlation_screen(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Pearson correlation of each column with the target, as one row per column."""
    row = df.agg(*[F.corr(c, target).alias(c) for c in cols])
    long = F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("r")) for c in cols]))
    return row.select(long).withColumns({"r_squared": F.col("r") * F.col("r"), "r_abs": F.abs("r")})


def weight_features(
    df: DataFrame, cols: list[str], target: str, exclude: tuple[str, ...] = ()
) -> DataFrame:
    """Standardised columns times 100 times the size of their correlation with the target.

    Columns in ``exclude`` leave the table.
    """
    used = [c for c in cols if c not in exclude]
    strength = df.agg(*[F.abs(F.corr(c, target)).alias(f"_{c}_r") for c in used])
    out = attach_stats(scale_z(df.drop(*exclude), used), strength)
    return out.withColumns({c: F.col(c) * F.col(f"_{c}_r") * 100 for c in used}).drop(
        *[f"_{c}_r" for c in used]
    )


def ols1(df: DataFrame, y: str, x: str, by: list[str] | None = None) -> DataFrame:
    """Least squares of ``y`` on ``x``, for the whole table or per group, over complete rows."""
    return df.groupBy(*(by or [])).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
    )


def line_model(y: str, x: str) -> Column:
    """Aggregate: intercept and slope of ``y`` on ``x`` over complete rows."""
    return F.struct(
        F.regr_intercept(y, x).alias("intercept"), F.array(F.regr_slope(y, x)).alias("slopes")
    )


def plane_model(y: str, x1: str, x2: str) -> Column:
    """Aggregate: intercept and both slopes of ``y`` on two columns over complete rows."""
    complete = F.col(y).isNotNull() & F.col(x1).isNotNull() & F.col(x2).isNotNull()
    cy, c1, c2 = (F.when(complete, F.col(c).cast("double")) for c in (y, x1, x2))
    v1, v2, c12 = F.var_samp(c1), F.var_samp(c2), F.covar_samp(c1, c2)
    k1, k2 = F.covar_samp(cy, c1), F.covar_samp(cy, c2)
    det = v1 * v2 - c12 * c12
    slope1 = F.try_divide(k1 * v2 - k2 * c12, det)
    slope2 = F.try_divide(k2 * v1 - k1 * c12, det)
    return F.struct(
        (F.avg(cy) - slope1 * F.avg(c1) - slope2 * F.avg(c2)).alias("intercept"),
        F.array(slope1, slope2).alias("slopes"),
    )


def ols2(df: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """Least squares of ``y`` on two columns over complete rows, in closed form and one pass."""
    fitted = df.where(none_missing(df, [y, x1, x2])).agg(
        plane_model(y, x1, x2).alias("m"), F.count("*").alias("n")
    )
    return fitted.select(
        F.col("m.slopes")[0].alias("slope1"), F.col("m.slopes")[1].alias("slope2"),
        F.col("m.intercept").alias("intercept"), "n",
    )


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Row counts of ``bins`` intervals of equal width; each includes its upper end, the first both."""
    values = df.select(F.col(col).cast("double").alias("_x"))
    placed = attach_stats(values, values.agg(F.min("_x").alias("_low"), F.max("_x").alias("_high")))
    width = (F.col("_high") - F.col("_low")) / bins
    steps = F.coalesce(F.ceil(F.try_divide(F.col("_x") - F.col("_low"), width)), F.lit(1))
    number = F.least(F.greatest(steps, F.lit(1)), F.lit(bins)).cast("int")
    return (
        placed.where(F.col("_x").isNotNull())
        .groupBy(number.alias("bin"), (F.col("_low") + width * (number - 1)).alias("from"),
                 (F.col("_low") + width * number).alias("to"))
        .agg(F.count("*").alias("n"))
    )


def chosen_breaks(low: float, high: float, rows: int) -> tuple[float, int, int]:
    """Step, first and last multiple of it, for intervals that suit the data.

    Sturges' rule gives the number of intervals wanted, ceil(log2(rows) + 1). The step is 1, 2, 5 or 10 times a power of
    ten: the next one as soon as the wanted width passes 1.4, 2.8 or 7 times that power. Breaks are the multiples of the step
    around the data; a constant column gets a step of 1.
    """
    if high == low:
        return 1.0, math.floor(low), math.floor(low) + 1
    width = (high - low) / math.ceil(math.log2(rows) + 1)
    power = 10.0 ** math.floor(math.log10(width))
    step = power * next(times for times, most in ((1, 1.4), (2, 2.8), (5, 7), (10, math.inf)) if width <= most * power)
    return step, math.floor(round(low / step, 9)), math.ceil(round(high / step, 9))


def histogram_chosen(df: DataFrame, col: str) -> DataFrame:
    """``histogram`` with breaks that the data choose (``chosen_breaks``); intervals without rows are left out.

    Each interval includes its upper end, the first both. Columns: ``bin`` from 1 on, ``from``, ``to`` and ``n``.
    """
    values = df.select(F.col(col).cast("double").alias("_x")).where("_x is not null and not isnan(_x)")
    seen = values.agg(F.min("_x").alias("low"), F.max("_x").alias("high"), F.count("*").alias("n")).first()
    if not seen.n:
        return values.select(F.lit(0).alias("bin"), F.col("_x").alias("from"), F.col("_x").alias("to"), F.lit(0).cast("long").alias("n"))
    step, first, _ = chosen_breaks(seen.low, seen.high, seen.n)
    number = F.greatest(F.ceil(F.round(F.col("_x") / step, 9)) - first, F.lit(1)).cast("int")
    counts = values.groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
    return counts.select("bin", ((F.col("bin") + (first - 1)) * step).alias("from"), ((F.col("bin") + first) * step).alias("to"), "n")
