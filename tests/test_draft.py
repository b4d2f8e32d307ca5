"""The draft analysis on a small made-up league."""

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from almanac.plans import draft


@pytest.fixture(scope="module")
def league(spark):
    r = np.random.default_rng(11)
    players = [f"p{i:02d}" for i in range(48)]
    passing, rushing, picks, sizes, named, tests, values = [], [], [], [], [], [], []
    for i, p in enumerate(players):
        drafted = 1996 + i % 8
        for season in (drafted - 2, drafted - 1):
            school = f"s{i % 4}"
            att = int(r.integers(50, 300))
            passing.append((p, school, season, float(r.integers(8, 14)), att * r.uniform(0.4, 0.7), float(att), att * r.uniform(5, 9),
                            att * r.uniform(0.01, 0.08), att * r.uniform(0.01, 0.05)))
            if i % 9:
                rushing.append((p, school, season, 12.0, float(r.integers(5, 90)), float(r.integers(10, 400)),
                                float(r.integers(0, 9)), float(r.integers(0, 5)), float(r.integers(0, 60)), 0.0))
        picks.append((drafted, 1 + i // 8, i + 1, p.upper(), "QB", 21.0 + i % 4, f"College {i % 5}", f"P{i:02d}", p))
        sizes.append((drafted, 1 + i // 8, i + 1, f"6-{i % 6}" if i % 3 else None, 200 + i if i % 3 else None))
        measured = [float(x) if r.uniform() > 0.2 else None for x in
                    (r.uniform(4.4, 5), r.uniform(28, 38), r.uniform(100, 125), r.uniform(4, 4.6), r.integers(10, 25), r.uniform(6.7, 7.4))]
        if drafted < 2000:
            named.append((drafted, p.upper(), f"College {i % 5}", *measured, "6-4", 220.0))
        else:
            tests.append((f"P{i:02d}", drafted, f"College {i % 5}", *measured, "6-4", 220.0))
        for n in range(5):
            if drafted + n <= 2005 and i % 7:
                values.append((f"P{i:02d}", f"{drafted + n}*", float(r.integers(0, 15))))
    standings = [(y, f"s{s}", float(r.normal()), float(r.normal()), float(r.uniform(15, 40)), float(r.uniform(15, 40)))
                 for y in range(1994, 2004) for s in range(4)]
    make = spark.createDataFrame
    measures = "forty double, vertical double, broad_jump double, shuttle double, bench double, cone double, ht string, wt double"
    return {
        "passing": make(passing, "player_id string, school string, season int, g double, cmp double, att double, yds double, td double, int double"),
        "rushing": make(rushing, "player_id string, school string, season int, g double, att double, yds double, td double, rec double, yds_2 double, td_2 double"),
        "standings": make(standings, "season int, school_name string, srs double, sos double, off double, def double"),
        "picks": make(picks, "season int, round int, pick int, pfr_player_name string, position string, age double, college string, pfr_player_id string, cfb_player_id string"),
        "sizes": make(sizes, "season int, round int, pick int, height string, weight long"),
        "named": make(named, f"season int, pfr_player_name string, college string, {measures}"),
        "tests": make(tests, f"pfr_player_id string, season int, college string, {measures}"),
        "values": make(values, "player_id string, year string, av double"),
    }


@pytest.fixture(scope="module")
def seasons(league):
    standings = draft.indexed_standings(league["standings"]).cache()
    passing = draft.passing_seasons(league["passing"], standings)
    rushing = draft.rushing_seasons(league["rushing"], standings)
    return passing, rushing, draft.receiving_seasons(league["rushing"], standings), standings


@pytest.fixture(scope="module")
def rows(league, seasons):
    careers = draft.college_careers(draft.quarterback_seasons(seasons[0], seasons[1]))
    picks = draft.imputed_tests(draft.draft_with_tests(league["picks"], league["sizes"], league["named"], league["tests"]))
    cohorts = league["picks"].select(F.col("pfr_player_id").alias("player_id"), "season")
    values = draft.first_five_seasons(league["values"], cohorts, as_of=2005, train_until=2001)
    return draft.model_rows(values, picks, careers).cache()


def test_seasons_against_pandas(league, seasons):
    raw = league["passing"].toPandas()
    rate = raw.groupby("season")[["yds", "att"]].sum()
    raw["want"] = raw.yds - raw.season.map(rate.yds / rate["att"]) * raw["att"]
    got = seasons[0].toPandas().set_index(["player_id", "season"]).yards_plus
    want = raw.set_index(["player_id", "season"]).want
    assert np.allclose(got.sort_index(), want.sort_index())
    raw = league["rushing"].toPandas()
    rate = raw.groupby("season")[["yds", "rec"]].sum()
    raw["want"] = 100 * raw.yds_2 / raw.rec / raw.season.map(rate.yds / rate.rec)
    got = seasons[2].toPandas().set_index(["player_id", "season"]).rec_yards_att_plus.astype(float)
    want = raw[raw.rec > 0].set_index(["player_id", "season"]).want
    assert np.allclose(got.loc[want.index], want) and got.drop(want.index).isna().all()


def test_player_tables_and_careers(league, seasons):
    passing, rushing, receiving, _ = seasons
    quarterbacks = draft.quarterback_seasons(passing, rushing)
    assert quarterbacks.count() == league["passing"].count()
    assert quarterbacks.where("rush_att is null").count() == league["passing"].count() - league["rushing"].count()
    careers = {r.cfbref_id: r for r in draft.college_careers(quarterbacks).collect()}
    raw = quarterbacks.toPandas().fillna(0)
    one = raw[raw.player_id == "p01"]
    assert careers["p01"].att == pytest.approx(one["att"].sum())
    assert careers["p01"].srs == pytest.approx((one.srs * one.g).sum() / one.g.sum())
    backs = draft.college_careers(draft.running_back_seasons(rushing, receiving))
    assert {"rec", "rec_yards_att_plus", "rush_att"} <= set(backs.columns)
    assert backs.count() == league["rushing"].select("player_id").distinct().count()


def test_draft_table_is_complete(league):
    merged = draft.draft_with_tests(league["picks"], league["sizes"], league["named"], league["tests"])
    assert merged.count() == 48
    assert {r.height_inches for r in merged.where("pick % 3 = 1").collect()} == {76.0}
    filled = draft.imputed_tests(merged)
    assert filled.dropna(subset=draft.MEASURES).count() == 48


def test_predictions_rankings_and_scores(rows):
    n = rows.count()
    assert 20 < n <= 48
    for features in draft.FEATURES:
        predicted = draft.predicted_classes(rows, features)
        assert predicted.where("predicted is null").count() == 0
    ranked = draft.ranked_classes(draft.predicted_classes(rows, "combine"))
    scores = draft.class_scores(ranked).collect()
    assert sum(r.n for r in scores) == n and all(-1 <= r.our_tau <= 1 for r in scores if r.our_tau is not None)
    assert draft.overall_scores(draft.predicted_classes(rows, "college")).first().n == n


def test_neighbors_and_stacked_model(rows):
    for position in draft.NEIGHBORS:
        out = draft.projected_by_neighbors(rows, position, ["age", *draft.MEASURES, *draft.COLLEGE])
        assert out.count() == rows.count()
        assert f"comp_{draft.NEIGHBORS[position]['comps']}" in out.columns
    stacked = draft.stacked_model(rows, LinearRegression)
    assert {"passer_rating", "rusher_rating", "athleticism_rating", "success_rating", "predicted"} <= set(stacked.columns)
