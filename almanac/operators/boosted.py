"""Boosted trees for every held-out group, all from one pass over the rows.

Trees of one split add up to a sum of one step function per feature. What boosting needs to know of the rows is then how
many fall into each pair of bins, and the sum of the target per bin: the sum of the residuals of a bin is its target sum
less the counts of its pairs times the steps so far. These histograms are added up per group once; the model for a
group is boosted on the totals minus its own, inside the task of the group, and no fit reads a row again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from almanac.functions.missing import none_missing
from almanac.operators.joins import null_safe_join
from almanac.operators.settle import settle
from almanac.session import ship_package

BINS = 32


def leave_group_out_boosted(
    df: DataFrame, group: str, features: list[str], target: str, rounds: int = 100, rate: float = 0.1, bins: int = BINS,
    leaf_rows: int = 5,
) -> DataFrame:
    """Add ``predicted``: boosted trees of one split, fitted on all other groups.

    Every feature is cut at the same ``bins`` quantiles of all rows for all groups. A round takes the split, with ``leaf_rows``
    rows or more on both sides, that lowers the squared error most (equal ones: the first feature, the lowest cut) and
    adds ``rate`` times the mean residual of each side. Rows that miss a value train nothing and get no prediction; a group without
    any others gets none either. The driver holds the edges and the total histogram, whose size is given by the
    features and bins; groups are rows of a table, however many.
    """
    ship_package(df.sparkSession)
    # Read three times: for the edges, the mean and the histograms.
    whole = settle(df.where(none_missing(df, [*features, target])).select(*dict.fromkeys([group, *features, target])))
    edges = _edges(whole, features, bins)
    if edges is None:
        return df.withColumn("predicted", F.lit(None).cast("double"))
    sizes = [len(e) + 1 for e in edges]
    first = np.concatenate(([0], np.cumsum(sizes))).astype(int).tolist()
    centre = whole.agg(F.avg(target)).first()[0]
    places = F.array(*[_bin_of(F.col(c), e) + start for c, e, start in zip(features, edges, first)])
    binned = whole.select(group, places.alias("at"), (F.col(target) - F.lit(centre)).cast("double").alias("y"))
    pairs = F.flatten(F.transform("at", lambda a, i: F.transform(
        F.slice("at", i + 1, F.lit(len(features))), lambda b: F.struct(a.alias("a"), b.alias("b"))
    )))
    own = settle(
        binned.select(group, "y", F.explode(pairs).alias("p"))
        .groupBy(group, F.col("p.a").alias("a"), F.col("p.b").alias("b"))
        .agg(F.count("*").cast("double").alias("n"), F.sum(F.when(F.col("p.a") == F.col("p.b"), F.col("y"))).alias("y"))
    )
    total = own.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).collect()
    counts, sums = _dense(np.array([r.a for r in total]), np.array([r.b for r in total]), np.array([r.n for r in total]),
                          np.array([r.y or 0.0 for r in total]), first[-1])
    schema = T.StructType([own.schema[group], T.StructField("steps", T.ArrayType(T.DoubleType()))])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        n, y = _dense(pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["n"].to_numpy(), pdf["y"].fillna(0).to_numpy(), first[-1])
        steps = boosted_steps(counts - n, sums - y, sizes, rounds, rate, leaf_rows)
        return pdf.iloc[:1][[group]].assign(steps=[steps])

    models = settle(own.groupBy(group).applyInPandas(fit, schema))
    joined = null_safe_join(df.withColumn("_at", F.when(none_missing(df, features), places)), models, [group], "left")
    predicted = F.aggregate("_at", F.get("steps", F.lit(first[-1])) + centre, lambda acc, at: acc + F.get("steps", at))
    # A missing target is no reason to have no prediction in itself, but such rows take no part, as in the linear fit.
    return joined.withColumn("predicted", F.when(F.col(target).isNotNull(), predicted)).select(*df.columns, "predicted")


def _bin_of(value: Column, edges: list[float]) -> Column:
    """How many edges lie below a value."""
    cuts = F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>")
    return F.size(F.filter(cuts, lambda cut: cut < value))


def _edges(whole: DataFrame, features: list[str], bins: int) -> list[list[float]] | None:
    """Distinct inner quantiles of every feature; None for no rows."""
    shares = [i / bins for i in range(1, bins)]
    row = whole.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 100_000).alias(f"e{i}") for i, c in enumerate(features)]).first()
    return None if row is None or row[0] is None else [sorted(set(e)) for e in row]


def _dense(a: np.ndarray, b: np.ndarray, n: np.ndarray, y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    counts, sums = np.zeros((size, size)), np.zeros(size)
    a, b = a.astype(int), b.astype(int)
    counts[a, b] = counts[b, a] = n
    same = a == b
    sums[a[same]] = y[same]
    return counts, sums


def boosted_steps(
    counts: np.ndarray, sums: np.ndarray, sizes: list[int], rounds: int, rate: float, leaf_rows: int
) -> list[float] | None:
    """The value of every bin, and the start value at the end, from the pair counts and target sums of all bins."""
    first = np.concatenate(([0], np.cumsum(sizes)))
    rows = np.diag(counts)
    n = rows[: sizes[0]].sum()
    if n <= 0:
        return None
    start = sums[: sizes[0]].sum() / n
    residual = sums - start * rows
    steps = np.zeros(len(sums))
    for _ in range(rounds):
        best = (0.0, None)
        for f, (lo, hi) in enumerate(zip(first[:-1], first[1:])):
            left_n, left = np.cumsum(rows[lo:hi])[:-1], np.cumsum(residual[lo:hi])[:-1]
            whole = residual[lo:hi].sum()
            right_n, right = n - left_n, whole - left
            fits = (left_n >= leaf_rows) & (right_n >= leaf_rows)
            if not fits.any():
                continue
            gain = np.full(len(left), -np.inf)
            gain[fits] = left[fits] ** 2 / left_n[fits] + right[fits] ** 2 / right_n[fits] - whole**2 / n
            cut = int(gain.argmax())
            if gain[cut] > best[0] * (1 + 1e-12) + 1e-300:
                best = (gain[cut], (lo, lo + cut + 1, hi, left[cut] / left_n[cut], right[cut] / right_n[cut]))
        if best[1] is None:
            break
        lo, middle, hi, below, above = best[1]
        change = np.zeros(len(sums))
        change[lo:middle], change[middle:hi] = rate * below, rate * above
        steps += change
        residual -= counts @ change
    return [*steps.tolist(), float(start)]
