import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from almanac.operators.boosted import _edges, leave_group_out_boosted
from almanac.operators.holdout import (
    leave_group_out, leave_group_out_ranges, leave_group_out_with, refit_groups, stacked_linear, stacked_predict,
)
from almanac.operators.impute import impute_cascade
from almanac.operators.joins import attach_stats, join_prefer_left, null_safe_join, subtract_rows
from almanac.operators.keys import (
    first_n, keep_first, match_by_name, numeric_rows, repeated_keys, replace_groups, rule_filter, split_rows,
    union_all, zip_rows,
)
from almanac.operators.numbering import Down, row_numbers, running_before
from almanac.operators.ranking import rank_within
from almanac.operators.rates import above_average, career_rollup, index_to_mean, index_to_rate, weighted_composite
from almanac.operators.summary import correlation_screen, histogram, ols1, ols2, scale_z, weight_features


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_null_safe_join_matches_missing_keys_and_keeps_both_copies(spark):
    a = spark.createDataFrame([(1, None, "a"), (2, "x", "b"), (3, "y", "c")], "id int, k string, v string")
    b = spark.createDataFrame([(None, "n"), ("x", "m"), ("x", "o")], "k string, v string")
    assert rows(null_safe_join(a, b, ["k"], "left"), "id", "v_y") == [
        (None, 1, "a", "n"), ("x", 2, "b", "m"), ("x", 2, "b", "o"), ("y", 3, "c", None)
    ]
    assert rows(join_prefer_left(a, b.dropDuplicates(["k"]), ["k"]), "id") == [
        (None, 1, "a"), ("x", 2, "b"), ("y", 3, "c")
    ]
    with pytest.raises(ValueError):
        null_safe_join(a, b, ["k"], "outer")


def test_subtract_rows_keeps_repeats_and_treats_missing_as_equal(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x"), (2, "x"), (3, "y")], "id int, k string")
    b = spark.createDataFrame([(1, None, 5), (3, "z", 6)], "id int, k string, other int")
    assert rows(subtract_rows(a, b), "id", "k") == [(2, "x"), (2, "x"), (3, "y")]


def test_attach_stats_refuses_two_rows(spark):
    df = spark.range(3)
    assert rows(attach_stats(df, df.agg(F.max("id").alias("m"))), "id") == [(0, 2), (1, 2), (2, 2)]
    with pytest.raises(Exception):
        attach_stats(df, spark.range(2).withColumnRenamed("id", "m")).collect()


def test_first_rows_and_repeated_keys(spark):
    df = spark.createDataFrame(
        [(1, "a", 3), (2, "a", 1), (3, "b", 2), (4, None, 5), (5, None, 4)], "id int, k string, o int"
    )
    assert rows(keep_first(df, ["k"], [F.asc("o")]), "id") == [(2, "a", 1), (3, "b", 2), (5, None, 4)]
    assert rows(first_n(df, ["k"], [F.desc("o")], 2), "id") == rows(df, "id")
    assert [r[0] for r in rows(repeated_keys(df, ["k"]), "id")] == [1, 2, 4, 5]
    unique = df.groupBy("k").count().where("count = 1").count()
    assert repeated_keys(df, ["k"]).count() + unique == df.count()


def test_zip_rows_pairs_by_place(spark):
    a = spark.createDataFrame([(1, 10, "x"), (1, 30, "y"), (2, 5, "z")], "p int, at int, a string")
    b = spark.createDataFrame([(1, 2, "m"), (1, 9, "n"), (1, 11, "o")], "p int, at int, b string")
    assert rows(zip_rows(a, b, "p", "at", "at").select("p", "a", "b"), "a") == [(1, "x", "m"), (1, "y", "n")]


def test_match_by_name_settles_doubtful_names(spark):
    a = spark.createDataFrame(
        [(1, "Al", "Texas"), (2, "Bo", "Ohio"), (2, "Bo", "Utah"), (3, "Cy", "Iowa"), (4, "Di", "Yale"), (5, "Ed", None)],
        "season int, name string, college string",
    )
    b = spark.createDataFrame(
        [(1, "Al", "Texas Tech", 1.0), (1, "Al", "Maine", 2.0), (2, "Bo", "Ohio", 3.0), (3, "Cy", "Rice", 4.0),
         (4, "Di", "Duke", 5.0), (4, "Di", "Army", 6.0)],
        "season int, name string, college string, forty double",
    )
    assert rows(match_by_name(a, b, ["season", "name"], "college"), "season", "college", "forty") == [
        (1, "Al", "Texas", 1.0), (2, "Bo", "Ohio", 3.0), (2, "Bo", "Utah", None), (3, "Cy", "Iowa", 4.0),
        (4, "Di", "Yale", 5.0), (4, "Di", "Yale", 6.0), (5, "Ed", None, None),
    ]


def test_replace_stack_split_and_filters(spark):
    df = spark.createDataFrame([(1, "a", "7"), (2, "b", "x"), (3, "b", "9")], "id int, g string, t string")
    new = df.where("g = 'a'").withColumn("t", F.lit("new"))
    assert rows(replace_groups(df, new, ["g"]), "id") == [(1, "a", "new"), (2, "b", "x"), (3, "b", "9")]
    assert rows(union_all([df.select("id"), None, df.select("g", "id").where("id = 1")]), "id", "g") == [
        (1, None), (1, "a"), (2, None), (3, None)
    ]
    assert [part.count() for part in split_rows(df, [1, 0], 1)] == [3, 0]
    many = spark.range(3000).withColumn("v", F.col("id") % 7)
    sides = [{r.id for r in part.collect()} for part in split_rows(many, [0.7, 0.1, 0.2], 9, ["id"])]
    assert sum(map(len, sides)) == 3000 == len(set().union(*sides)) and 2000 < len(sides[0]) < 2200
    again = [{r.id for r in part.collect()} for part in split_rows(many.repartition(7).drop("v"), [0.7, 0.1, 0.2], 9, ["id"])]
    assert again == sides != [{r.id for r in part.collect()} for part in split_rows(many, [0.7, 0.1, 0.2], 10, ["id"])]
    assert [part.select("v").distinct().count() for part in split_rows(many, [1, 1], 2, ["v"])] in ([n, 7 - n] for n in range(8))
    assert [r[0] for r in rows(numeric_rows(df, "t", 0), "id")] == [1, 3]
    assert [r[0] for r in rows(numeric_rows(df, "t", 0, 8), "id")] == [1]
    kept = rule_filter(df, F.col("id") <= 2, F.col("g") == "a", F.col("t") == "9")
    assert [r[0] for r in rows(kept, "id")] == [1, 3]


def test_numbering_of_hot_groups(spark):
    r = np.random.default_rng(5)
    data = [("hot" if i % 3 else ("b" if i % 2 else None), i, int(v)) for i, v in enumerate(r.integers(0, 20, 90))]
    df = spark.createDataFrame(data, "g string, id int, v int")
    want, totals = {}, {}
    for g in {g for g, _, _ in data}:
        group = sorted((v, i) for h, i, v in data if h == g)
        for n, (v, i) in enumerate(group):
            want[i], totals[i] = n + 1, sum(x for x, _ in group[:n])
    order = ["v", F.col("id")]
    assert {r.id: r.n for r in row_numbers(df, ["g"], order, "n").collect()} == want
    got = running_before(df, ["g"], {"s": (order, F.col("v"))})
    assert {r.id: r.s for r in got.collect()} == totals
    # Counts, weights and another order at once.
    got = running_before(df, ["g"], {"s": (order, F.col("v")), "n": (order, None), "back": ([Down("id")], F.col("v"))})
    assert got.columns == ["g", "id", "v", "s", "n", "back"]
    assert got.schema["n"].dataType.simpleString() == "bigint"
    back = {i: sum(v for h, j, v in data if h == g and j > i) for g, i, _ in data}
    assert {r.id: (r.s, r.n + 1, r.back) for r in got.collect()} == {i: (totals[i], want[i], back[i]) for i in want}
    assert row_numbers(df.limit(0), ["g"], order, "n").count() == 0


def test_rank_overall_and_within(spark):
    df = spark.createDataFrame([(1, "a", 3.0), (2, "a", 3.0), (3, "b", 9.0)], "id int, g string, v double")
    specs = {"high": [Down("v"), "id"], "low": ["v", Down("id")]}
    assert rows(rank_within(df, [], specs), "id") == [(1, "a", 3.0, 2, 2), (2, "a", 3.0, 3, 1), (3, "b", 9.0, 1, 3)]
    assert rows(rank_within(df, ["g"], specs), "id") == [(1, "a", 3.0, 1, 2), (2, "a", 3.0, 2, 1), (3, "b", 9.0, 1, 1)]


def test_adjusted_rates(spark):
    df = spark.createDataFrame(
        [(1, 2000, 30.0, 10.0), (2, 2000, 10.0, 10.0), (3, 2000, 0.0, 0.0), (4, None, 8.0, 2.0)],
        "id int, season int, yds double, att double",
    )
    out = rows(above_average(df, {"plus": ("yds", "att")}, ["season"]).select("id", "plus"), "id")
    assert out == [(1, 10.0), (2, -10.0), (3, None), (4, 0.0)]
    out = rows(index_to_rate(df, {"idx": ("yds", "att")}, ["season"]).select("id", "idx"), "id")
    assert out == [(1, 150.0), (2, 50.0), (3, None), (4, 100.0)]
    out = rows(index_to_mean(df, ["yds"], ["season"]).select("id", "yds_plus"), "id")
    assert [o[1] for o in out] == pytest.approx([225.0, 75.0, 0.0, 100.0])


def test_career_rollup(spark):
    df = spark.createDataFrame([("a", 10.0, 1.0), ("a", 30.0, 2.0), ("b", 0.0, 5.0)], "p string, g double, srs double")
    assert rows(career_rollup(df, ["p"], ["g"], {"srs": "g"}), "p") == [("a", 40.0, 1.75), ("b", 0.0, None)]


def test_least_squares_over_complete_rows(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(80, 2))
    y = 3 + 2 * x[:, 0] - x[:, 1] + r.normal(size=80)
    data = [(float(a), float(b), float(c)) for (a, b), c in zip(x, y)]
    df = spark.createDataFrame(data + [(None, 1.0, 1.0), (1.0, float("nan"), 1.0)], "a double, b double, y double")
    slopes = np.linalg.lstsq(np.c_[np.ones(80), x], y, rcond=None)[0]
    row = ols2(df, "y", "a", "b").first()
    assert (row.intercept, row.slope1, row.slope2, row.n) == pytest.approx((*slopes, 80))
    line = np.polyfit(x[:, 0], y, 1)
    row = ols1(df.where("b is not null and not isnan(b)"), "y", "a").first()
    assert (row.slope, row.intercept, row.n) == pytest.approx((*line, 80))


def test_screen_histogram_and_weights(spark):
    df = spark.createDataFrame([(float(i), float(-i), float(i * i)) for i in range(5)], "x double, z double, y double")
    screen = {r.variable: r for r in correlation_screen(df, ["x", "z"], "y").collect()}
    assert screen["x"].r == pytest.approx(-screen["z"].r) and screen["z"].r_abs == pytest.approx(screen["x"].r)
    assert rows(histogram(df, "x", 2).select("bin", "from", "to", "n"), "bin") == [(1, 0.0, 2.0, 3), (2, 2.0, 4.0, 2)]
    assert rows(histogram(df.where("x = 3"), "x", 4).select("bin", "n"), "bin") == [(1, 1)]
    weighted = weight_features(df, ["x", "z"], "y", exclude=("z",))
    assert weighted.columns == ["x", "y"]
    z = scale_z(df, ["x"]).orderBy("y").first().x
    assert weighted.orderBy("y").first().x == pytest.approx(z * screen["x"].r_abs * 100)
    weights = spark.createDataFrame([("x", 0.5), ("z", 0.25)], "variable string, r_squared double")
    out = weighted_composite(df, {"c": ["x", "z"]}, weights).orderBy("x").collect()
    assert out[3].c == pytest.approx((3 * 0.5 - 3 * 0.25) / 0.75)


def test_imputation_in_stages(spark):
    # y = 2x and z = y + 1 where known; w has no usable predictor in the last row.
    df = spark.createDataFrame(
        [(1, 1.0, 2.0, 3.0), (2, 2.0, 4.0, 5.0), (3, 3.0, None, None), (4, 4.0, float("nan"), 9.0), (5, None, None, None)],
        "id int, x double, y double, z double",
    )
    out = impute_cascade(df, [{"y": [("x",)]}, {"z": [("y",)]}])
    got = rows(out, "id")
    assert [g[2] for g in got[:4]] == pytest.approx([2.0, 4.0, 6.0, 8.0])
    assert [g[3] for g in got[:4]] == pytest.approx([3.0, 5.0, 7.0, 9.0])
    assert got[4] == (5, None, None, None)


def test_first_available_predictor_set_wins(spark):
    r = np.random.default_rng(7)
    data = [(i, float(a), float(b), float(a + 2 * b)) for i, (a, b) in enumerate(r.normal(size=(30, 2)))]
    data += [(100, 1.0, None, None), (101, 1.0, 2.0, None)]
    df = spark.createDataFrame(data, "id int, a double, b double, t double")
    got = {r.id: r.t for r in impute_cascade(df, [{"t": [("a", "b"), ("a",)]}]).collect()}
    line = np.polyfit([d[1] for d in data[:30]], [d[3] for d in data[:30]], 1)
    assert got[101] == pytest.approx(5.0)
    assert got[100] == pytest.approx(np.polyval(line, 1.0))


@pytest.fixture(scope="module")
def seasons(spark):
    r = np.random.default_rng(8)
    data = []
    for i in range(60):
        a, b = r.normal(size=2)
        data.append((i, 2000 + i % 4 if i else None, float(a), float(b), float(1 + a - 3 * b + r.normal())))
    return spark.createDataFrame(data, "id int, season int, a double, b double, y double").cache()


def test_leave_group_out_equals_a_refit(spark, seasons):
    data = seasons.collect()
    got = {r.id: r.predicted for r in leave_group_out(seasons, "season", ["a", "b"], "y").collect()}
    for season in {d.season for d in data}:
        rest = [d for d in data if d.season != season]
        fit = np.linalg.lstsq(np.array([[1, d.a, d.b] for d in rest]), np.array([d.y for d in rest]), rcond=None)[0]
        for d in data:
            if d.season == season:
                assert got[d.id] == pytest.approx(fit @ [1, d.a, d.b])
    other = leave_group_out_with(seasons, "season", ["a", "b"], "y", lambda: LinearRegression(solver="normal"), [2000, 2001])
    other = {r.id: r.predicted for r in other.collect()}
    assert len(other) == 29 and other == pytest.approx({i: got[i] for i in other})


def test_ranges_of_other_groups(seasons):
    data = seasons.collect()
    for r in leave_group_out_ranges(seasons, "season", ["a"]).collect():
        rest = [d.a for d in data if d.season != r.season]
        assert (r.a_min, r.a_max) == (min(rest), max(rest))


def test_boosted_groups_equal_separate_fits(spark):
    r = np.random.default_rng(7)
    data = [(i, int(g), float(a), float(b), float(2 * a - (b > 1) * 3 + e)) for i, (g, a, b, e) in enumerate(zip(
        r.integers(0, 6, 240), r.integers(0, 40, 240), r.normal(size=240).round(1), r.normal(size=240)))]
    data += [(900, None, 3.0, 0.5, 1.0), (901, 1, None, 0.0, 1.0), (902, 1, 2.0, 0.0, None), (903, 9, float("nan"), 0.0, 1.0)]
    df = spark.createDataFrame(data, "id int, g int, a double, b double, y double")
    got = {x.id: x.predicted for x in leave_group_out_boosted(df, "g", ["a", "b"], "y", rounds=25, rate=0.2, bins=8).collect()}
    whole = [d for d in data if None not in d[2:] and d[2] == d[2]]
    cuts = _edges(df.where("a is not null and y is not null and not isnan(a)"), ["a", "b"], 8)
    at = np.array([[np.searchsorted(cuts[j], d[2 + j], side="left") for j in (0, 1)] for d in whole])
    y = np.array([d[4] for d in whole])
    for g in {d[1] for d in whole}:
        train = np.array([d[1] != g for d in whole])
        own = ~train
        fitted, predicted = np.full(train.sum(), y[train].mean()), np.full(own.sum(), y[train].mean())
        for _ in range(25):
            residual = y[train] - fitted
            best = (1e-9, None)
            for j in (0, 1):
                for cut in range(len(cuts[j])):
                    left = at[train][:, j] <= cut
                    if min(left.sum(), (~left).sum()) < 5:
                        continue
                    gain = (residual[left].sum() ** 2 / left.sum() + residual[~left].sum() ** 2 / (~left).sum()
                            - residual.sum() ** 2 / len(residual))
                    if gain > best[0] + 1e-9:
                        best = (gain, (j, cut, residual[left].mean(), residual[~left].mean()))
            j, cut, below, above = best[1]
            fitted += 0.2 * np.where(at[train][:, j] <= cut, below, above)
            predicted += 0.2 * np.where(at[own][:, j] <= cut, below, above)
        assert [got[d[0]] for d, o in zip(whole, own) if o] == pytest.approx(predicted.tolist(), abs=1e-9)
    assert all(got[i] is None for i in (901, 902, 903)) and len(got) == len(data)
    # The plan does not grow with the groups.
    plans = [leave_group_out_boosted(df.withColumn("g", F.col("id") % n), "g", ["a", "b"], "y", rounds=2) for n in (2, 50)]
    sizes = [p._jdf.queryExecution().optimizedPlan().toString().count("\n") for p in plans]
    assert sizes[0] == sizes[1]
    assert leave_group_out_boosted(df.limit(0), "g", ["a", "b"], "y").count() == 0
    alone = leave_group_out_boosted(df.where("g = 1"), "g", ["a", "b"], "y").collect()
    assert alone and all(x.predicted is None for x in alone)


def test_stacked_lines_equal_separate_fits(seasons):
    data = seasons.collect()
    out = {r.id: r for r in stacked_linear(seasons, {"one": ["a"], "two": ["b", "a"]}, "y", F.col("id") % 4, also=("b",)).collect()}
    a, b, y = (np.array([getattr(d, c) for d in data], dtype=float) for c in "aby")
    fold = np.array([d.id % 4 for d in data])
    ratings = np.zeros((len(data), 2))
    for f in range(4):
        for k, columns in enumerate(([a], [b, a])):
            x = np.column_stack([np.ones(len(data)), *columns])
            w = np.linalg.lstsq(x[fold != f], y[fold != f], rcond=None)[0]
            ratings[fold == f, k] = x[fold == f] @ w
    x = np.column_stack([np.ones(len(data)), ratings, b])
    want = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert [out[d.id].one_rating for d in data] == pytest.approx(ratings[:, 0].tolist())
    assert [out[d.id].two_rating for d in data] == pytest.approx(ratings[:, 1].tolist())
    assert [out[d.id].predicted for d in data] == pytest.approx(want.tolist())
    few = stacked_linear(seasons.limit(1), {"one": ["a"]}, "y", F.lit(0)).first()
    assert few.one_rating is None and few.predicted is None
    assert stacked_linear(seasons.limit(0), {"one": ["a"]}, "y", F.lit(0)).count() == 0


def test_stacking_and_refit(seasons):
    out = stacked_predict(seasons, {"one": ["a"], "two": ["b"]}, "y", LinearRegression, also=("a",))
    assert out.columns == [*seasons.columns, "one_rating", "two_rating", "predicted"]
    assert out.count() == 60
    failed = out.withColumn("predicted", F.when(F.col("season") == 2001, 0.0).otherwise(F.col("predicted")))
    fixed = refit_groups(failed, "season", lambda df: df.withColumn("predicted", F.lit(1.0)))
    assert {r.predicted for r in fixed.where("season = 2001").collect()} == {1.0}
    assert fixed.count() == 60


def test_leave_group_out_without_other_groups(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 3.0)], "g int, x double, y double")
    assert [r.predicted for r in leave_group_out(df, "g", ["x"], "y").collect()] == [None, None]
