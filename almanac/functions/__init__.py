"""Column expressions: missing values, scalars and aggregates."""

from almanac.functions.aggregates import group_rate, strict_sum, weighted_mean
from almanac.functions.missing import clear_missing, is_missing, present
from almanac.functions.scalars import (
    euclidean,
    feet_inches,
    leading_year,
    link_id,
    min_max,
    number,
    prefix_match,
    un_min_max,
    z_score,
)

__all__ = [
    "clear_missing", "euclidean", "feet_inches", "group_rate", "is_missing", "leading_year",
    "link_id", "min_max", "number", "prefix_match", "present", "strict_sum", "un_min_max",
    "weighted_mean", "z_score",
]
