"""Every operator as a query on the test tables."""

from almanac.plans.catalog import (  # noqa: F401
    aggregates, filters, joins, keys, models, pages, projections, rankings, sources,
)
from almanac.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
