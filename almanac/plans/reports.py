"""Scores of a predicted ranking against the outcome and against a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from almanac.operators.holdout import leave_group_out
from almanac.operators.kendall import kendall_tau
from almanac.operators.neighbors import knn_predict
from almanac.operators.numbering import Down
from almanac.operators.ranking import rank_within
from almanac.operators.settle import settle
from almanac.operators.summary import scale_z, weight_features


def prediction_rankings(
    df: DataFrame, by: list[str], predicted: str, outcome: str, baseline: str, tie: str,
    outcome_ties: str = "prediction",
) -> DataFrame:
    """Add ``our_ranking``, ``real_ranking`` and ``baseline_ranking`` within each group.

    Predictions and outcomes rank from high to low, the baseline from low to high. With ``outcome_ties`` of
    ``"prediction"`` equal outcomes rank by the prediction, and equal baselines by the outcome; with ``"baseline"``
    equal outcomes rank by the baseline, and equal baselines by the prediction. What is still equal
    ranks by ``tie``.
    """
    if outcome_ties not in ("prediction", "baseline"):
        raise ValueError("outcome_ties is 'prediction' or 'baseline'")
    ours = [Down(predicted), tie]
    low_first = F.coalesce(F.col(baseline).isNull(), F.lit(False))  # missing baselines last
    base = [low_first, baseline]
    if outcome_ties == "prediction":
        real = [Down(outcome), *ours]
        base = [*base, *real]
    else:
        base = [*base, *ours]
        real = [Down(outcome), *base]
    return rank_within(df, by, {"our_ranking": ours, "real_ranking": real, "baseline_ranking": base})


def ranking_report(ranked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Tau and p-value of our ranking and of the baseline against the real one, side by side.

    Both rankings are groups of one table, so one run scores them.
    """
    keys = by or []
    names = {"our_ranking": "our", "baseline_ranking": "baseline"}
    rankings = F.explode(F.array(*[F.struct(F.lit(name).alias("which"), F.col(c).alias("ranking")) for c, name in names.items()]))
    stacked = ranked.select(*keys, "real_ranking", rankings.alias("_r")).select(
        *keys, F.col("_r.which").alias("_which"), F.col("_r.ranking").alias("ranking"), "real_ranking"
    )
    scored = kendall_tau(stacked, "ranking", "real_ranking", [*keys, "_which"])

    def of(name: str, column: str):
        return F.max(F.when(F.col("_which") == name, F.col(column)))

    return scored.groupBy(*keys).agg(
        of("our", "n").alias("n"), of("our", "tau").alias("our_tau"), of("our", "p_value").alias("our_p_value"),
        of("baseline", "tau").alias("baseline_tau"), of("baseline", "p_value").alias("baseline_p_value"),
    )


def holdout_report(
    df: DataFrame, group: str, features: list[str], target: str, baseline: str, tie: str
) -> DataFrame:
    """Predict each group from all others, rank its rows and score the ranking against the baseline."""
    predicted = settle(
        leave_group_out(df, group, features, target).select(group, tie, target, baseline, "predicted")
    )
    return ranking_report(prediction_rankings(predicted, [group], "predicted", target, baseline, tie), [group])


def neighbor_projection(
    df: DataFrame,
    id_col: str,
    features: list[str],
    target: str,
    k: int,
    exponent: float = 1.0,
    comps: int = 3,
    weighted: bool = False,
    exclude: tuple[str, ...] = (),
) -> DataFrame:
    """Predict every row from its nearest neighbours among the others on standardised features.

    ``weighted`` stretches each feature by its correlation with the target, ``exclude`` leaves features
    out. Rows without a prediction are dropped.
    """
    used = [c for c in features if c not in exclude]
    rows = df.select(id_col, target, *used)
    scaled = settle(weight_features(rows, used, target) if weighted else scale_z(rows, used))
    predicted = knn_predict(scaled, id_col, used, target, k, exponent, comps)
    return df.select(id_col, target).join(predicted.where(F.col("predicted").isNotNull()), id_col)
