"""Row numbers and running totals over groups of any size, several orders in one pass.

All orders and groups share one range partition, so a group that holds most of the rows is spread
over many tasks like any other. A place in a group is the place in the whole sort less the place at
which the group starts; places in the whole sort need one number per partition from the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from almanac.operators.joins import null_safe_join
from almanac.operators.settle import settle

# Spark's monotonically_increasing_id keeps the partition in the bits above these 33.
_ROW_BITS = 33


class Down:
    """A sort key from high to low, missing values last; a plain column goes from low to high, missing values first."""

    def __init__(self, key: str | Column):
        self.key = key


def _column(key: str | Column | Down) -> Column:
    key = key.key if isinstance(key, Down) else key
    return F.col(key) if isinstance(key, str) else key


def running_before(
    df: DataFrame, by: list[str], specs: dict[str, tuple[list[str | Column | Down], Column | None]]
) -> DataFrame:
    """Add, per entry ``name: (order, weight)``, the total weight of the earlier rows of the group.

    A weight of ``None`` counts rows; weights are whole numbers, a missing one adds nothing. ``order`` must
    settle every tie and holds columns, ``Down`` for those from high to low. Missing group keys are equal.
    All results are long. Groups may have any size, also that of the whole table.
    """
    columns = df.columns
    if len(specs) == 1:
        # The rows themselves go through the sort.
        (name, (order, weight)), = specs.items()
        keys = {f"_key_{i}": _column(key) for i, key in enumerate(order)}
        sort = [F.col(f"_key_{i}").desc_nulls_last() if isinstance(key, Down) else F.col(f"_key_{i}")
                for i, key in enumerate(order)]
        rows = df.withColumns({**keys, "_weight": _weight(weight)})
        placed = _totals_before(rows, by, sort, weight is None)
        kept = [_quoted(c) for c in columns if c.lower() != name.lower()]
        return placed.select(*kept, F.col("_before").alias(name))

    # One narrow row per row and order: its number, its group, its keys and its weight.
    rows = settle(df.withColumn("_row", F.monotonically_increasing_id()))
    stacked, sort = [], [F.col("_which")]
    for which, (order, weight) in enumerate(specs.values()):
        keys = [_column(key).alias(f"_key_{which}_{i}") for i, key in enumerate(order)]
        stacked.append(rows.select(
            "_row", *[_quoted(c) for c in by], F.lit(which).alias("_which"), _weight(weight).alias("_weight"), *keys
        ))
        sort += [F.col(f"_key_{which}_{i}").desc_nulls_last() if isinstance(key, Down) else F.col(f"_key_{which}_{i}")
                 for i, key in enumerate(order)]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked)
    sort = [sort[0], *[_quoted(c) for c in by], *sort[1:]]
    counts_only = all(weight is None for _, weight in specs.values())
    placed = _totals_before(together, ["_which", *by], sort[1 + len(by):], counts_only)
    wide = placed.groupBy("_row").agg(
        *[F.max(F.when(F.col("_which") == which, F.col("_before"))).alias(name) for which, name in enumerate(specs)]
    )
    taken = {name.lower() for name in specs}
    kept = [F.col(f"a.`{c}`") for c in columns if c.lower() not in taken]
    return rows.alias("a").join(wide.alias("b"), F.col("a._row") == F.col("b._row")).select(
        *kept, *[F.col(f"b.`{name}`") for name in specs]
    )


def row_numbers(df: DataFrame, by: list[str], order: list[str | Column | Down], name: str) -> DataFrame:
    """Add the place of each row in its group, from 1 on, as a long."""
    out = running_before(df, by, {name: (order, None)})
    return out.withColumn(name, F.col(name) + 1)


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def _weight(weight: Column | None) -> Column:
    return F.lit(1).cast("long") if weight is None else F.coalesce(weight.cast("long"), F.lit(0))


def _totals_before(rows: DataFrame, by: list[str], sort: list[Column], counts_only: bool) -> DataFrame:
    """Add ``_before``: the weight of the rows before each row among those of its group."""
    ordered = settle(
        rows.orderBy(*[_quoted(c) for c in by], *sort).withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", _ROW_BITS))
    # One row per range partition, whatever the groups.
    parts = ordered.groupBy("_part").agg(F.sum("_weight").alias("_total"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(parts.select("_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset")))
    if counts_only:
        # The sort has numbered the rows of a partition already.
        within = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    else:
        inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        ordered = ordered.withColumn("_within", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
        within = F.col("_within")
    placed = ordered.join(offsets, "_part").withColumn("_before", F.col("_offset") + within)
    if not by:
        return placed
    starts = placed.groupBy(*[_quoted(c) for c in by]).agg(F.min("_before").alias("_start"))
    return null_safe_join(placed, starts, by).withColumn("_before", F.col("_before") - F.col("_start"))
