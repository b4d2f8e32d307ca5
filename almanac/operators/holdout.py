"""Prediction of each group from all the other groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from multiprocessing.pool import ThreadPool
from operator import add

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F, types as T

from almanac.functions.missing import none_missing
from almanac.functions.scalars import min_max
from almanac.operators.joins import attach_stats, matching_rows, null_safe_join
from almanac.operators.keys import replace_groups, union_all
from almanac.operators.settle import settle
from almanac.session import ship_package


def leave_group_out_ranges(df: DataFrame, group: str, cols: list[str]) -> DataFrame:
    """Per group the bounds of every column over all other groups, as ``<col>_min`` and ``<col>_max``.

    The extreme of the others is the overall one, or the runner-up for the group that holds it.
    """
    own = settle(
        df.groupBy(group).agg(
            *[F.min(c).alias(f"{c}_min") for c in cols], *[F.max(c).alias(f"{c}_max") for c in cols]
        )
    )
    marks = [f"{c}_{end}" for c in cols for end in ("min", "max")]

    def best(name: str, col: Column) -> Column:
        return F.min(col) if name.endswith("_min") else F.max(col)

    def holder(name: str) -> Column:
        pick = F.min_by if name.endswith("_min") else F.max_by
        return pick(group, F.when(F.col(name).isNotNull(), F.struct(name, group)))

    top = own.agg(*[x for m in marks for x in (best(m, F.col(m)).alias(m), holder(m).alias(f"{m}_of"))]).first()
    is_top = {m: F.col(group).eqNullSafe(F.lit(top[f"{m}_of"])) for m in marks}
    second = own.agg(*[best(m, F.when(~is_top[m], F.col(m))).alias(m) for m in marks]).first()
    kinds = {m: own.schema[m].dataType for m in marks}
    return own.select(
        group,
        *[F.when(is_top[m], F.lit(second[m])).otherwise(F.lit(top[m])).cast(kinds[m]).alias(m) for m in marks],
    )


def leave_group_out(df: DataFrame, group: str, features: list[str], target: str) -> DataFrame:
    """Add ``predicted``: the linear fit on all other groups, applied to the rows of the group.

    Sums of products are taken once per group. The fit for a group uses the totals minus its
    own sums, so no group is read twice. Rows that miss a value train nothing and get no prediction.
    """
    ship_package(df.sparkSession)
    names = [*features, target]
    whole = df.where(none_missing(df, names))
    centre = whole.agg(*[F.avg(c).alias(c) for c in names]).first()
    shifted = [F.col(c).cast("double") - F.lit(centre[c] or 0.0) for c in names]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names)) if i < len(features)]
    sums = settle(
        whole.groupBy(group).agg(
            F.count("*").cast("double").alias("n"),
            F.array(*[F.sum(x) for x in shifted]).alias("first"),
            F.array(*[F.sum(shifted[i] * shifted[j]) for i, j in pairs]).alias("second"),
        )
    )
    total = sums.agg(
        F.sum("n").alias("n"),
        F.array(*[F.sum(F.col("first")[i]) for i in range(len(names))]).alias("first"),
        F.array(*[F.sum(F.col("second")[i]) for i in range(len(pairs))]).alias("second"),
    ).first()
    if total.n is None:
        return df.withColumn("predicted", F.lit(None).cast("double"))
    schema = T.StructType(
        [sums.schema[group], T.StructField("intercept", T.DoubleType()),
         T.StructField("slopes", T.ArrayType(T.DoubleType()))]
    )
    models = settle(sums.mapInPandas(_solver(group, total, pairs, len(features)), schema))
    line = F.col("intercept") + F.lit(centre[target])
    for i, c in enumerate(features):
        line = line + F.col("slopes")[i] * (F.col(c) - F.lit(centre[c]))
    return null_safe_join(df, models, [group], "left").withColumn("predicted", line).select(
        *df.columns, "predicted"
    )


def _solver(group: str, total, pairs: list[tuple[int, int]], p: int):
    all_n, all_first, all_second = total.n, np.array(total.first), np.array(total.second)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for n, first, second in zip(pdf["n"], pdf["first"], pdf["second"]):
                rest = all_n - n
                if rest <= p:
                    out.append((None, None))
                    continue
                mean = (all_first - first) / rest
                moments = np.zeros((p + 1, p + 1))
                for (i, j), value in zip(pairs, all_second - second):
                    moments[i, j] = moments[j, i] = value - rest * mean[i] * mean[j]
                slopes = np.linalg.lstsq(moments[:p, :p], moments[:p, p], rcond=None)[0]
                out.append((float(mean[p] - slopes @ mean[:p]), slopes.tolist()))
            yield pd.DataFrame(
                {group: pdf[group], "intercept": [a for a, _ in out], "slopes": [b for _, b in out]}
            )

    return solve


def leave_group_out_screen(df: DataFrame, group: str, cols: list[str], target: str) -> DataFrame:
    """Per group ``<col>_r2``: squared correlation of each column with the target over all other groups.

    Like ``leave_group_out``, from the totals minus the sums of the group itself.
    """
    names = [*cols, target]
    whole = df.where(none_missing(df, names))
    centre = whole.agg(*[F.avg(c).alias(c) for c in names]).first()
    shifted = {c: F.col(c).cast("double") - F.lit(centre[c] or 0.0) for c in names}
    y = shifted[target]
    sums = settle(
        whole.groupBy(group).agg(
            F.count("*").cast("double").alias("_n"), F.sum(y).alias("_y"), F.sum(y * y).alias("_yy"),
            *[F.sum(shifted[c]).alias(f"_{c}_x") for c in cols],
            *[F.sum(shifted[c] * shifted[c]).alias(f"_{c}_xx") for c in cols],
            *[F.sum(shifted[c] * y).alias(f"_{c}_xy") for c in cols],
        )
    )
    parts = [c for c in sums.columns if c != group]
    both = attach_stats(sums, sums.agg(*[F.sum(c).alias(f"all{c}") for c in parts]))
    rest = {c: F.col(f"all{c}") - F.col(c) for c in parts}

    def r_squared(c: str) -> Column:
        n, sx, sy = rest["_n"], rest[f"_{c}_x"], rest["_y"]
        cov = n * rest[f"_{c}_xy"] - sx * sy
        spread = (n * rest[f"_{c}_xx"] - sx * sx) * (n * rest["_yy"] - sy * sy)
        return F.try_divide(cov * cov, spread).alias(f"{c}_r2")

    return both.select(group, *[r_squared(c) for c in cols])


def held_out_composites(
    df: DataFrame, group: str, parts: dict[str, list[str]], target: str, weights_of_all_rows: bool = False
) -> DataFrame:
    """Add one composite per entry ``name: columns``, made for each group from all other groups.

    The columns are scaled to 0..1 between the bounds of the other groups and weighted by their squared
    correlation with the target there. ``weights_of_all_rows`` takes the correlations over all rows
    instead, the group itself included, which lets its outcome leak into its features.
    """
    cols = sorted({c for part in parts.values() for c in part})
    out = null_safe_join(df, settle(leave_group_out_ranges(df, group, cols)), [group])
    if weights_of_all_rows:
        out = attach_stats(out, df.agg(*[F.pow(F.corr(c, target), F.lit(2.0)).alias(f"{c}_r2") for c in cols]))
    else:
        out = null_safe_join(out, settle(leave_group_out_screen(df, group, cols, target)), [group])

    def composite(part: list[str]) -> Column:
        scaled = [min_max(F.col(c), F.col(f"{c}_min"), F.col(f"{c}_max")) * F.col(f"{c}_r2") for c in part]
        return F.try_divide(reduce(add, scaled), reduce(add, [F.col(f"{c}_r2") for c in part]))

    return out.withColumns({name: composite(part) for name, part in parts.items()}).select(*df.columns, *parts)


def leave_group_out_with(
    df: DataFrame,
    group: str,
    features: list[str],
    target: str,
    learner: Callable[[], object],
    groups: list,
    parallelism: int = 4,
) -> DataFrame:
    """``leave_group_out`` for any ``pyspark.ml`` regressor; one distributed fit for each of the named groups.

    ``learner`` makes an unfitted regressor. Features are scaled to 0..1 on the training side.
    ``parallelism`` fits are submitted at a time. Rows that miss a value take no part. The plan grows with the list;
    ``leave_group_out`` and ``leave_group_out_boosted`` predict all groups of a table, however many.
    """
    data = settle(df.where(none_missing(df, [*features, target])))

    @inheritable_thread_target(df.sparkSession)
    def predict(value) -> DataFrame:
        own = F.col(group).eqNullSafe(F.lit(value))
        model = _regression(features, target, "predicted", learner).fit(data.where(~own))
        return model.transform(data.where(own)).select(*df.columns, F.col("predicted"))

    with ThreadPool(parallelism) as pool:
        parts = pool.map(predict, groups)
    if not parts:
        return data.withColumn("predicted", F.lit(None).cast("double"))
    return union_all(parts)


def _regression(features: list[str], target: str, output: str, learner: Callable[[], object]) -> Pipeline:
    raw, scaled = f"_{output}_raw", f"_{output}_scaled"
    regressor = learner()
    regressor.setFeaturesCol(scaled).setLabelCol(target).setPredictionCol(output)
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol=raw),
            MinMaxScaler(inputCol=raw, outputCol=scaled),
            regressor,
        ]
    )


def stacked_predict(
    df: DataFrame,
    categories: dict[str, list[str]],
    target: str,
    learner: Callable[[], object],
    also: tuple[str, ...] = (),
) -> DataFrame:
    """One model per category of features, then a model on their scores.

    Adds ``<category>_rating`` per category and ``predicted``. Columns in ``also`` enter the last
    model as they are. Rows that miss a value are left out.
    """
    used = [c for cols in categories.values() for c in cols]
    data = settle(df.where(none_missing(df, [*used, *also, target])))
    ratings = [f"{name}_rating" for name in categories]
    scored = data
    for rating, cols in zip(ratings, categories.values()):
        model = _regression(cols, target, rating, learner).fit(data)
        scored = model.transform(scored)
    scored = scored.select(*data.columns, *ratings)
    final = _regression([*ratings, *also], target, "predicted", learner).fit(scored)
    return final.transform(scored).select(*data.columns, *ratings, "predicted")


def stacked_linear(
    df: DataFrame, categories: dict[str, list[str]], target: str, fold: Column, also: tuple[str, ...] = ()
) -> DataFrame:
    """``stacked_predict`` for linear models, from one pass, with scores that their own rows did not teach.

    ``fold`` deals the rows to a few folds; it should depend on a row's key only. The ``<category>_rating`` of a row comes
    from the other folds, and the last model is fitted on those ratings. One aggregate takes the sums of products per fold: the models
    of a fold solve the totals minus its own, and the sums of products of the ratings follow from those of the
    features. Columns in ``also`` enter the last model as they are. Rows that miss a value are left out; with fewer rows
    than coefficients all results are null.
    """
    names = sorted({c for cols in categories.values() for c in cols} | set(also)) + [target]
    data = df.where(none_missing(df, names)).withColumn("_fold", fold)
    ratings = [f"{name}_rating" for name in categories]
    shift = data.select(*names).first()
    if shift is None:
        return df.limit(0).withColumns({c: F.lit(None).cast("double") for c in [*ratings, "predicted"]})
    # Any row of the table serves as the origin.
    x = [F.lit(1.0), *[F.col(c).cast("double") - F.lit(float(shift[c])) for c in names]]
    size = len(x)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    moments = {}
    for row in data.groupBy("_fold").agg(F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("m")).collect():
        m = np.zeros((size, size))
        for (i, j), value in zip(pairs, row.m):
            m[i, j] = m[j, i] = value
        moments[row["_fold"]] = m
    total = sum(moments.values())
    place = {c: i + 1 for i, c in enumerate(names)}
    # Per fold the ratings, the columns in ``also`` and the target as combinations of 1 and the features.
    forms, second = {}, 0
    for key, own in moments.items():
        rows = [_line_of(total - own, [place[c] for c in cols], size) for cols in categories.values()]
        for c in (*also, target):
            rows.append(np.eye(size)[place[c]])
        forms[key] = np.array([np.eye(size)[0], *rows])
        second = second + forms[key] @ own @ forms[key].T
    last = _line_of(second, list(range(1, len(second) - 1)), len(second))
    # A table of a few rows, one per fold.
    coefficients = df.sparkSession.createDataFrame(
        [(key, form[1 : len(ratings) + 1].ravel().tolist()) for key, form in forms.items()],
        T.StructType([T.StructField("_fold", data.schema["_fold"].dataType), T.StructField("_w", T.ArrayType(T.DoubleType()))]),
    )
    out = null_safe_join(data, coefficients, ["_fold"])
    for k, rating in enumerate(ratings):
        line = F.get("_w", F.lit(k * size))
        for i in range(1, size - 1):
            line = line + F.get("_w", F.lit(k * size + i)) * x[i]
        out = out.withColumn(rating, F.nanvl(line + F.lit(float(shift[target])), F.lit(None)))
    # Ratings are back in the units of the target; the last model works on both less the origin.
    parts = [F.col(c) - F.lit(float(shift[target])) for c in ratings] + [x[place[c]] for c in also]
    predicted = F.lit(float(last[0]) + float(shift[target]))
    for w, part in zip(last[1:], parts):
        predicted = predicted + F.lit(float(w)) * part
    return out.withColumn("predicted", F.nanvl(predicted, F.lit(None))).select(*df.columns, *ratings, "predicted")


def _line_of(moments: np.ndarray, used: list[int], size: int) -> np.ndarray:
    """Coefficients of the last column on 1 and the ``used`` ones, in a row of ``size``; NaN with too few rows."""
    out = np.zeros(size)
    n = moments[0, 0]
    if not n > len(used):
        return np.full(size, np.nan)
    mean = moments[0] / n
    centred = moments - n * np.outer(mean, mean)
    slopes = np.linalg.lstsq(centred[np.ix_(used, used)], centred[used, len(moments) - 1], rcond=None)[0]
    out[used] = slopes
    out[0] = mean[len(moments) - 1] - slopes @ mean[used]
    return out


def refit_groups(
    predictions: DataFrame, group: str, refit: Callable[[DataFrame], DataFrame], predicted: str = "predicted"
) -> DataFrame:
    """Refit the groups whose mean prediction is 0, a sign of a failed fit, and replace their rows.

    ``refit`` gets the rows of those groups and returns them predicted anew.
    """
    failed = (
        predictions.groupBy(group).agg(F.avg(predicted).alias("_mean")).where(F.col("_mean") == 0).select(group)
    )
    failed = settle(failed)
    again = refit(matching_rows(predictions, failed, [group], "left_semi"))
    return replace_groups(predictions, again, [group])
