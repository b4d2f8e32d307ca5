"""Rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from almanac.operators.numbering import Down, running_before


def rank_within(df: DataFrame, by: list[str], specs: dict[str, list[str | Column | Down]]) -> DataFrame:
    """Add one ranking per entry ``name: order``, from 1 on, within each group of ``by``.

    With no ``by`` the ranking is over the whole table. ``order`` must settle every tie. Rankings are long,
    and all of them come from one sort of the stacked orders.
    """
    out = running_before(df, by, {name: (order, None) for name, order in specs.items()})
    return out.withColumns({name: F.col(name) + 1 for name in specs})
