"""Filling gaps by staged regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from almanac.functions.missing import present
from almanac.operators.joins import attach_stats
from almanac.operators.summary import line_model, plane_model

# One stage: target column -> its predictor sets, best first, each of one or two columns.
Stage = dict[str, list[tuple[str, ...]]]


def _model(target: str, predictors: tuple[str, ...]) -> Column:
    if len(predictors) == 1:
        return line_model(target, *predictors)
    if len(predictors) == 2:
        return plane_model(target, *predictors)
    raise ValueError("a predictor set has one or two columns")


def _flat(name: str, predictors: tuple[str, ...]) -> list[Column]:
    slopes = [F.col(f"{name}.slopes")[i].alias(f"{name}_{i}") for i in range(len(predictors))]
    return [F.col(f"{name}.intercept").alias(name), *slopes]


def _estimate(name: str, predictors: tuple[str, ...]) -> Column:
    total = F.col(name)
    for i, predictor in enumerate(predictors):
        total = total + F.col(f"{name}_{i}") * F.col(predictor)
    return total


def impute_cascade(df: DataFrame, stages: list[Stage]) -> DataFrame:
    """Fill the gaps of each stage's targets from the first predictor set that has values.

    All models of a stage come from one aggregate over the input of that stage; the next
    stage is fitted on its output. A gap with no usable predictor stays.
    """
    columns = df.columns
    touched = {c for stage in stages for t, sets in stage.items() for c in [t, *[p for s in sets for p in s]]}
    df = df.withColumns({c: present(F.col(c).cast("double")) for c in sorted(touched)})
    for stage in stages:
        models = {
            f"_{target}_{i}": (target, predictors)
            for target, sets in stage.items()
            for i, predictors in enumerate(sets)
        }
        fits = df.agg(*[_model(*spec).alias(name) for name, spec in models.items()])
        fits = fits.select(*[c for name, (_, predictors) in models.items() for c in _flat(name, predictors)])
        fitted = attach_stats(df, fits)
        fills = {
            target: F.coalesce(
                F.col(target), *[_estimate(f"_{target}_{i}", p) for i, p in enumerate(sets)]
            )
            for target, sets in stage.items()
        }
        df = fitted.withColumns(fills).select(*columns)
    return df
