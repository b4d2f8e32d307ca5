"""Kendall's rank correlation without forming pairs of rows.

Pairs out of order are counted by sorting. A large group is cut into strips of equal ranks along both columns: pairs that
share a strip are counted inside it. For pairs that share none, the strips are the ranks and the occupied cells of
their grid the weighted rows of a smaller problem of the same kind, which is counted, or cut, in the same way. All counts are
whole numbers of any size.
"""

from __future__ import annotations

import math
from decimal import Decimal
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from almanac.functions.missing import is_missing
from almanac.operators.joins import matching_rows, null_safe_join
from almanac.operators.keys import union_all
from almanac.operators.numbering import running_before
from almanac.operators.settle import settle
from almanac.session import ship_package

# Distinct pairs of values in the largest group that one task counts whole.
STRIP_ROWS = 1 << 20

# Larger groups are cut into strips of this part of it (or of a multiple of the square root of their number, if that is more): a
# task holds up to twice a strip, or now and then two or three strips that share a pack.
STRIPS, PACKS = 8, 32

# Below this many rows without ties the p-value is exact.
_EXACT_BELOW = 50


def kendall_tau(
    df: DataFrame,
    a: str,
    b: str,
    by: list[str] | None = None,
    strip_rows: int = STRIP_ROWS,
) -> DataFrame:
    """Tau-b of two columns per group (or over all rows) with its two-sided p-value.

    Columns: the group, ``n``, ``tau``, ``z`` and ``p_value``. Rows that miss a value are left
    out. A constant column or a single row gives a null tau.
    """
    ship_package(df.sparkSession)
    keys = by or ["_all"]
    values = df.where(~is_missing(df, a) & ~is_missing(df, b))
    if not by:
        values = values.withColumn("_all", F.lit(0))
    # Copies collapse here, on the map side first; everything below works on distinct pairs.
    cells = settle(
        values.groupBy(*keys, F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("w"))
    )
    out = _scored(cells, _out_of_order(cells, keys, strip_rows), keys)
    return out if by else out.drop("_all")


def _out_of_order(cells: DataFrame, keys: list[str], strip_rows: int) -> DataFrame:
    """Per group the number of row pairs ordered one way by x and the other way by y."""
    counts = []
    while True:
        packs = PACKS * cells.count() // strip_rows
        whole = [*keys, F.lit(0).alias("_axis"), F.lit(0).cast("long").alias("_strip"), "x", "y", "w"]
        large = settle(cells.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > strip_rows))
        if large.isEmpty():
            counts.append(_count_in_strips(cells.select(*whole), keys, packs))
            return reduce(DataFrame.unionByName, counts).groupBy(*keys).agg(F.sum("d").alias("d"))
        placed = _place_in_strips(cells, large, keys, strip_rows)
        # Pairs in one strip of x, and all pairs of the small groups.
        along_x = placed.where(~F.col("_x_single")).select(
            *keys, F.lit(1).alias("_axis"), F.col("_x_strip").alias("_strip"), "x", "y", "w"
        )
        small = matching_rows(cells, large, keys, "left_anti").select(*whole)
        counts.append(_count_in_strips(small.unionByName(along_x), keys, packs))
        # Pairs in one strip of y but in different strips of x, whose numbers stand for x, whatever the type of x.
        across = placed.where(~F.col("_y_single")).groupBy(*keys, "_y_strip", "_x_strip", "y").agg(
            F.sum("w").alias("w")
        ).select(
            *keys, F.lit(2).alias("_axis"), F.col("_y_strip").alias("_strip"), F.col("_x_strip").alias("x"), "y", "w"
        )
        counts.append(_count_in_strips(across, keys, packs))
        # Pairs that share neither strip: the occupied cells of the grid, at most a quarter as many as before.
        cells = settle(placed.groupBy(*keys, F.col("_x_strip").alias("x"), F.col("_y_strip").alias("y")).agg(
            F.sum("w").alias("w")
        ))


def _place_in_strips(
    cells: DataFrame, large: DataFrame, keys: list[str], strip_rows: int
) -> DataFrame:
    """Give each distinct pair of a large group its strip along x and along y.

    Strips follow exact ranks among the distinct pairs and hold less than twice the strip size (``strip_rows / STRIPS``) of
    them. A single value with more pairs than that has a strip of its own, in which nothing is
    out of order.
    """
    size = F.greatest(F.lit(max(1, strip_rows // STRIPS)), F.ceil(4 * F.sqrt("n"))).cast("long")
    placed = null_safe_join(cells, large.select(*keys, size.alias("_size")), keys)
    for axis in ("x", "y"):
        totals = settle(placed.groupBy(*keys, axis, "_size").agg(F.count("*").alias("_n")))
        ranked = running_before(totals, keys, {"_before": ([axis], F.col("_n"))})
        single = F.col("_n") >= F.col("_size")
        strip = 2 * F.floor(F.col("_before") / F.col("_size")) + single.cast("int")
        ranked = ranked.select(
            *keys, axis, strip.cast("long").alias(f"_{axis}_strip"), single.alias(f"_{axis}_single")
        )
        placed = null_safe_join(placed, ranked, [*keys, axis])
    return settle(placed)


def _count_in_strips(strips: DataFrame, keys: list[str], packs: int) -> DataFrame:
    """Count inside each strip; many small strips share one pack, so that tasks get enough rows."""
    schema = strips.select(*keys).schema.add("d", "decimal(38,0)")
    least = int(strips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pack = F.pmod(F.xxhash64(*keys, "_axis", "_strip"), F.lit(max(least, packs)))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        strip = pdf.groupby([*keys, "_axis", "_strip"], dropna=False, sort=False)
        segment = strip.ngroup().to_numpy()
        found = inversions(segment, pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())
        first = ~pdf.duplicated([*keys, "_axis", "_strip"])
        out = pdf.loc[first, keys].copy()
        out["d"] = [Decimal(v) for v in found[segment[first.to_numpy()]]]
        return out

    return strips.groupBy(pack.alias("_pack")).applyInPandas(count, schema)


# Weights and their sums are handled in parts of this many bits, so that a product of two parts fits into 64.
_PART = 31


def _parts(values: list[np.ndarray]) -> list[np.ndarray]:
    """Numbers given as parts of any size, as parts of ``_PART`` bits; the highest ones only if they are needed."""
    out, carry = [], 0
    for value in values:
        value = value + carry
        out.append(value & ((1 << _PART) - 1))
        carry = value >> _PART
    while np.any(carry):
        out.append(carry & ((1 << _PART) - 1))
        carry = carry >> _PART
    return out


def inversions(segment: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weight of the pairs with smaller x and larger y, per segment (0, 1, 2, ...), as whole numbers of any size.

    Splits the ranks of y bit by bit from the top: at each bit, a row with a 0 is out of order
    with every earlier row of its block that has a 1. Then the zeros of each block move to its front.
    """
    n = len(segment)
    if n == 0:
        return np.zeros(0, dtype=object)
    order = np.lexsort((y, x, segment))
    segment = segment[order]
    w = _parts([w[order].astype(np.int64)])
    rank = np.unique(y, return_inverse=True)[1].reshape(-1)[order]
    segment_at = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    found: dict[int, np.ndarray] = {}  # per power of 2 ** _PART

    def count(power: int, values: np.ndarray) -> None:
        sums = np.add.reduceat(values, segment_at)
        found[power] = found[power] + sums if power in found else sums

    start = segment_at
    here = np.arange(n)
    for bit in range(int(rank.max()).bit_length() - 1, -1, -1):
        lengths = np.diff(np.r_[start, n])
        one = (rank >> bit) & 1
        ahead = []
        for part in w:
            heavy = one * part
            before = np.cumsum(heavy) - heavy
            ahead.append(before - np.repeat(before[start], lengths))
        ahead = _parts(ahead)
        for i, part in enumerate(w):
            light = (1 - one) * part
            for j, other in enumerate(ahead):
                product = light * other
                count(i + j, product & ((1 << _PART) - 1))
                if len(w) > 1 or len(ahead) > 1 or product.max(initial=0) >> _PART:
                    count(i + j + 1, product >> _PART)
        zeros_before = np.cumsum(1 - one) - (1 - one)
        zeros = np.add.reduceat(1 - one, start)
        zeros_before -= np.repeat(zeros_before[start], lengths)
        first = np.repeat(start, lengths)
        ones_before = here - first - zeros_before
        to = first + np.where(one == 1, np.repeat(zeros, lengths) + ones_before, zeros_before)
        moved = [np.empty_like(rank), *[np.empty_like(part) for part in w]]
        for new, old in zip(moved, [rank, *w]):
            new[to] = old
        rank, w = moved[0], moved[1:]
        start = np.unique(np.r_[start, (start + zeros)[zeros < lengths]])
    out = np.zeros(int(segment.max()) + 1, dtype=object)
    for power, sums in found.items():
        out[segment[segment_at]] += sums.astype(object) << (_PART * power)
    return out


def _scored(cells: DataFrame, out_of_order: DataFrame, keys: list[str]) -> DataFrame:
    exact = "decimal(18,0)"
    w, t = F.col("w").cast(exact), F.col("t").cast("double")
    parts = [out_of_order, cells.select(*keys, F.col("w").alias("n"), (w * (w - 1)).alias("_both"))]
    for axis in ("x", "y"):
        ties = cells.groupBy(*keys, axis).agg(F.sum("w").alias("t")).where(F.col("t") > 1)
        parts.append(
            ties.select(
                *keys, (F.col("t").cast(exact) * (F.col("t").cast(exact) - 1)).alias(f"_{axis}2"), (t * (t - 1) * (t - 2)).alias(f"_{axis}3"),
                (t * (t - 1) * (2 * t + 5)).alias(f"_{axis}v"),
            )
        )
    # One aggregate over the stacked parts instead of a join for each of them.
    sums = ["n", "d", "_both", *[f"_{axis}{term}" for axis in "xy" for term in "23v"]]
    scored = union_all(parts).groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]
    )
    n = F.col("n").cast("double")
    x2, y2 = F.col("_x2").cast("double"), F.col("_y2").cast("double")
    pairs = n * (n - 1) / 2
    # Pairs in order less pairs out of order, in whole numbers until they are divided.
    both = "decimal(38,0)"
    ordered = [F.col("n").cast(exact) * (F.col("n").cast(exact) - 1), -F.col("_x2"), -F.col("_y2"), F.col("_both"), -4 * F.col("d")]
    s = reduce(add, [c.cast(both) for c in ordered]).cast("double") / 2
    variance = reduce(
        add,
        [
            (n * (n - 1) * (2 * n + 5) - F.col("_xv") - F.col("_yv")) / 18,
            F.coalesce(F.try_divide(x2 * y2, 2 * n * (n - 1)), F.lit(0.0)),
            F.coalesce(
                F.try_divide(F.col("_x3") * F.col("_y3"), 9 * n * (n - 1) * (n - 2)), F.lit(0.0)
            ),
        ],
    )
    tau = F.try_divide(s, F.sqrt((pairs - x2 / 2) * (pairs - y2 / 2)))
    z = F.try_divide(s, F.sqrt(variance))
    no_ties = (x2 == 0) & (y2 == 0)
    return scored.select(*keys, "n", tau.alias("tau"), z.alias("z"), no_ties.alias("_no_ties"), "d").select(
        *keys, "n", "tau", F.when(F.col("tau").isNotNull(), F.col("z")).alias("z"),
        _p_value("n", "tau", "z", "_no_ties", F.col("d").cast("double")).alias("p_value"),
    )


@lru_cache(maxsize=_EXACT_BELOW)
def _up_to(n: int) -> np.ndarray:
    """P(number of pairs out of order <= 0, 1, 2, ...) when all orders are equally likely."""
    ways = np.ones(1)
    for size in range(2, n + 1):
        ways = np.convolve(ways, np.full(size, 1.0 / size))
    return np.cumsum(ways)


@F.pandas_udf(T.DoubleType())
def _p_value(
    n: pd.Series, tau: pd.Series, z: pd.Series, no_ties: pd.Series, d: pd.Series
) -> pd.Series:
    out = pd.Series(np.nan, index=n.index, dtype="float64")
    known = tau.notna()
    exact = known & no_ties & (n < _EXACT_BELOW)
    for size in n[exact].unique():
        rows = exact & (n == size)
        table = np.concatenate(([0.0], _up_to(int(size))))
        agree = len(table) - 2 - d[rows].to_numpy().astype(np.int64)
        out[rows] = np.minimum(1.0, 2 * np.minimum(table[agree + 1], 1 - table[agree]))
    normal = known & ~exact & z.notna()
    out[normal] = np.frompyfunc(math.erfc, 1, 1)((z[normal].abs() / math.sqrt(2)).to_numpy()).astype(np.float64)
    return out  # NaN becomes null
