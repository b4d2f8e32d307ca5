import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.operators.kendall import inversions, kendall_tau


def brute(x, y):
    """Tau-b and the two-sided p-value straight from the definitions."""
    n = len(x)
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(n) for j in range(i))
    tx = [x.count(v) for v in set(x)]
    ty = [y.count(v) for v in set(y)]
    pairs = n * (n - 1) / 2
    nx = sum(t * (t - 1) / 2 for t in tx)
    ny = sum(t * (t - 1) / 2 for t in ty)
    if pairs in (nx, ny):
        return None, None
    tau = s / math.sqrt((pairs - nx) * (pairs - ny))
    if nx == ny == 0 and n <= 7:
        sums = []
        for order in itertools.permutations(range(n)):
            sums.append(sum(np.sign(i - j) * np.sign(order[i] - order[j]) for i in range(n) for j in range(i)))
        sums = np.array(sums)
        return tau, min(1.0, 2 * min((sums <= s).mean(), (sums >= s).mean()))
    v = (n * (n - 1) * (2 * n + 5) - sum(t * (t - 1) * (2 * t + 5) for t in tx + ty)) / 18
    v += sum(t * (t - 1) for t in tx) * sum(t * (t - 1) for t in ty) / (2 * n * (n - 1))
    if n > 2:
        v += (
            sum(t * (t - 1) * (t - 2) for t in tx) * sum(t * (t - 1) * (t - 2) for t in ty)
            / (9 * n * (n - 1) * (n - 2))
        )
    return tau, math.erfc(abs(s / math.sqrt(v)) / math.sqrt(2))


def check(rows, got):
    groups = {}
    for g, x, y in rows:
        groups.setdefault(g, []).append((x, y))
    assert {r.g for r in got} == set(groups)
    for r in got:
        x, y = map(list, zip(*groups[r.g]))
        tau, p = brute(x, y)
        assert r.n == len(x)
        if tau is None:
            assert r.tau is None and r.p_value is None
        else:
            assert r.tau == pytest.approx(tau, abs=1e-12)
            assert r.p_value == pytest.approx(p, abs=1e-9)


def test_inversions_against_pairs():
    r = np.random.default_rng(0)
    for _ in range(60):
        n = r.integers(1, 50)
        segment = np.unique(r.integers(0, 4, n), return_inverse=True)[1]
        x, y, w = r.integers(0, 9, n), r.normal(size=n).round(1), r.integers(1, 4, n)
        want = [
            sum(
                w[i] * w[j] for i in range(n) for j in range(n)
                if segment[i] == segment[j] == s and x[i] < x[j] and y[i] > y[j]
            )
            for s in range(segment.max() + 1)
        ]
        assert list(inversions(segment, x, y, w)) == want


def test_inversions_of_huge_weights():
    # Products beyond 64 bits, and a total beyond them too.
    one = 2**31 + 1
    assert list(inversions(np.zeros(3, int), np.arange(3), np.array([3, 2, 1]), np.full(3, one))) == [3 * one * one]
    r = np.random.default_rng(8)
    x, y = r.integers(0, 12, 40), r.integers(0, 12, 40)
    w = np.array([int(v) for v in r.integers(1, 2**62, 40)])
    want = sum(int(w[i]) * int(w[j]) for i in range(40) for j in range(40) if x[i] < x[j] and y[i] > y[j])
    assert list(inversions(np.zeros(40, int), x, y, w)) == [want]


@pytest.mark.parametrize("strip_rows", [4, 16, 64, 256, 1 << 20])
def test_every_strip_size_gives_the_same(spark, strip_rows):
    r = np.random.default_rng(12)
    rows = [("a", float(p), float(q)) for p, q in zip(r.integers(0, 300, 900), r.integers(0, 30, 900))]
    rows += [("b", float(p), float(p // 7)) for p in r.integers(0, 90, 100)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    check(rows, kendall_tau(df, "x", "y", ["g"], strip_rows=strip_rows).collect())


def test_small_groups_with_and_without_ties(spark):
    r = np.random.default_rng(1)
    rows = [("one", 1.0, 2.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("two", 1.0, 2.0), ("two", 2.0, 1.0)]
    rows += [("exact", float(i), float(v)) for i, v in enumerate(r.permutation(7))]
    rows += [("ties", float(a), float(b)) for a, b in r.integers(0, 5, (30, 2))]
    rows += [(None, float(a), float(b)) for a, b in r.integers(0, 50, (60, 2))]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    check(rows, kendall_tau(df, "x", "y", ["g"]).collect())


def test_large_groups_are_cut_into_strips(spark):
    r = np.random.default_rng(2)
    rows = [("big", float(a), float(b)) for a, b in zip(r.normal(size=400).round(2), r.normal(size=400).round(2))]
    # A third of the rows shares one x, others share one y, and some are copies.
    rows += [("hot", 1.0 if i % 3 == 0 else float(i % 40), float(b)) for i, b in enumerate(r.integers(0, 60, 300))]
    rows += [("hot", float(b), 7.0) for b in r.integers(0, 60, 150)]
    rows += [("small", float(a), float(b)) for a, b in r.integers(0, 5, (6, 2))]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    check(rows, kendall_tau(df, "x", "y", ["g"], strip_rows=8).collect())


def test_extremes_and_missing(spark):
    df = spark.range(100).select(
        F.col("id").cast("double").alias("x"), (-F.col("id")).cast("double").alias("y")
    ).unionByName(spark.createDataFrame([(None, 1.0), (float("nan"), 2.0)], "x double, y double"))
    assert kendall_tau(df, "x", "x").first().tau == pytest.approx(1)
    row = kendall_tau(df, "x", "y").first()
    assert (row.n, row.tau) == (100, pytest.approx(-1))


def test_strips_of_a_large_group_stay_well_below_what_is_counted_whole(spark):
    from almanac.operators.kendall import STRIPS, _place_in_strips

    cells = spark.range(6000).select(
        F.lit("g").alias("g"), F.col("id").alias("x"), (F.col("id") * 7919 % 6007).alias("y"), F.lit(1).cast("long").alias("w")
    )
    large = cells.groupBy("g").agg(F.count("*").alias("n"))
    placed = _place_in_strips(cells, large, ["g"], 4800)
    for axis in "xy":
        assert max(r["count"] for r in placed.groupBy(f"_{axis}_strip").count().collect()) <= 2 * 4800 // STRIPS
