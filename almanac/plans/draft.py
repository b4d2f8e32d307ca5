"""The draft analysis end to end: college seasons, physical tests and professional value to scored rankings.

Each function is one step on tables with the column names of the football data; all the work is done by
the general operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from almanac.functions.missing import clear_missing
from almanac.functions.scalars import feet_inches, leading_year
from almanac.operators.holdout import held_out_composites, leave_group_out, stacked_predict
from almanac.operators.impute import impute_cascade
from almanac.operators.joins import null_safe_join
from almanac.operators.keys import keep_first, match_by_name
from almanac.operators.rates import career_rollup, index_to_mean
from almanac.operators.settle import settle
from almanac.operators.summary import scale_min_max
from almanac.plans.careers import adjusted_stats, cohort_projection, player_table
from almanac.plans.reports import neighbor_projection, prediction_rankings, ranking_report

# The columns, horizons and neighbour counts of the analysis.
STANDING = ["season", "school_name", "srs", "sos", "off_plus"]
TESTS = ["forty", "vertical", "broad_jump", "shuttle", "bench", "cone"]
MEASURES = ["height_inches", "weight", *TESTS]
PASSING = ["att", "yards_plus", "cmp_plus", "td_plus", "int_plus"]
RUSHING = ["rush_att", "rush_yards_plus", "rush_tds_plus"]
RECEIVING = ["rec", "rec_yards_att_plus", "td_rec_att_plus"]
SUCCESS = ["srs", "sos", "off_plus"]
COLLEGE = ["g", "att", "rush_att", *SUCCESS, *PASSING[1:], *RUSHING[1:]]
COMPOSITES = {"run": ["forty", "shuttle", "cone"], "jump": ["vertical", "broad_jump"]}
FEATURES = {
    "all": ["age", "height_inches", "weight", "run", "jump", *COLLEGE],
    "college": ["age", *COLLEGE],
    "combine": ["age", *MEASURES],
}
CATEGORIES = {
    "passer": ["g", *PASSING], "rusher": ["g", *RUSHING], "athleticism": MEASURES, "success": SUCCESS,
}
IMPUTATION = [
    {
        "bench": [("weight",)],
        "forty": [("shuttle",), ("weight",)],
        "vertical": [("broad_jump",), ("weight", "height_inches")],
    },
    {"broad_jump": [("vertical",)], "shuttle": [("forty",)]},
    {"cone": [("shuttle",)]},
]
# Fixed value: the player whose two drafts share one id.
LISTED_TWICE = ("EricCr00",)

HORIZON, AS_OF, TRAIN_UNTIL = 5, 2022, 2018
NEIGHBORS = {
    "QB": {"k": 30, "weighted": False, "exclude": ("sos",), "comps": 9},
    "WR": {"k": 15, "weighted": True, "exclude": ("broad_jump",), "comps": 3},
    "RB": {"k": 15, "weighted": True, "exclude": (), "comps": 3},
}


def indexed_standings(standings: DataFrame) -> DataFrame:
    """Standings with offence and defence as percentages of the season mean."""
    out = index_to_mean(standings, ["off", "def"], ["season"])
    return out.select(*STANDING, "def_plus")


def _with_standing(stats: DataFrame, standings: DataFrame, amounts=None, indexes=None) -> DataFrame:
    stats = stats.withColumnRenamed("school", "school_name")
    return adjusted_stats(
        stats, standings.select(*STANDING), "season", ["season", "school_name"], amounts, indexes
    )


def passing_seasons(passing: DataFrame, standings: DataFrame) -> DataFrame:
    """Passing above the season average per player and season, with the standing of the school."""
    amounts = {"yards_plus": ("yds", "att"), "cmp_plus": ("cmp", "att"), "td_plus": ("td", "att"), "int_plus": ("int", "att")}
    return _with_standing(passing, standings, amounts).select(*STANDING, "player_id", "g", *PASSING)


def rushing_seasons(rushing: DataFrame, standings: DataFrame) -> DataFrame:
    """Rushing above the season average per player and season, with the standing of the school."""
    amounts = {"rush_yards_plus": ("yds", "att"), "rush_tds_plus": ("td", "att")}
    out = _with_standing(rushing, standings, amounts).withColumnRenamed("att", "rush_att")
    return out.select(*STANDING, "player_id", "g", *RUSHING)


def receiving_seasons(rushing: DataFrame, standings: DataFrame, season_yards: str = "yds") -> DataFrame:
    """Receiving rates as percentages of the season rate.

    The season's yards per catch come from ``season_yards``: the rushing yards, as in the published
    tables, or ``yds_2`` for the receiving yards.
    """
    indexes = {"rec_yards_att_plus": ("yds_2", "rec", season_yards), "td_rec_att_plus": ("td_2", "rec")}
    return _with_standing(rushing, standings, indexes=indexes).select(*STANDING, "player_id", "g", *RECEIVING)


def quarterback_seasons(passing: DataFrame, rushing: DataFrame) -> DataFrame:
    """Passing seasons with the rushing of the same player and season."""
    return player_table(passing, rushing.drop("g"), [*STANDING, "player_id"])


def running_back_seasons(rushing: DataFrame, receiving: DataFrame) -> DataFrame:
    """Rushing seasons with the receiving of the same player and season."""
    return player_table(rushing, receiving, [*STANDING, "player_id", "g"])


def college_careers(seasons: DataFrame) -> DataFrame:
    """One row per player: totals, with team strength weighted by games and indexes by their volume."""
    weights = {**dict.fromkeys(SUCCESS, "g"), **dict.fromkeys(RECEIVING[1:], "rec")}
    weighted = {c: w for c, w in weights.items() if c in seasons.columns}
    sums = [c for c in ["g", *PASSING, *RUSHING, "rec"] if c in seasons.columns]
    rows = clear_missing(seasons, [*sums, *weighted]).withColumnRenamed("player_id", "cfbref_id")
    return career_rollup(rows, ["cfbref_id"], sums, weighted)


def _sizes_from_tests(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "height_inches": F.coalesce("height_inches", feet_inches(F.col("ht"))),
        "weight": F.coalesce(F.col("weight").cast("double"), F.col("wt").cast("double")),
    })


def draft_with_tests(picks: DataFrame, sizes: DataFrame, named_tests: DataFrame, tests: DataFrame) -> DataFrame:
    """Draft picks with sizes and physical tests.

    ``sizes`` join on season, round and pick. Picks before 2000 know their tests by name only
    (``named_tests``), later ones by id (``tests``). Picks without a player id are dropped.
    """
    pick = ["season", "round", "pick"]
    sized = keep_first(null_safe_join(picks, sizes, pick, "left"), pick, [F.asc("pfr_player_id"), F.asc("pfr_player_name")])
    sized = sized.withColumn("height_inches", feet_inches(F.col("height"))).drop("height")
    early = sized.where((F.col("season") >= 1987) & (F.col("season") < 2000))
    early = match_by_name(early, named_tests, ["season", "pfr_player_name"], "college", prefix=4)
    late = sized.where(F.col("season") >= 2000)
    late = late.join(tests.drop("college"), ["pfr_player_id", "season"])
    columns = [
        *pick, "pfr_player_name", "position", "age", *MEASURES, "college", "pfr_player_id", "cfb_player_id",
    ]
    return (
        _sizes_from_tests(late).select(*columns)
        .unionByName(_sizes_from_tests(early).select(*columns))
        .where(F.col("pfr_player_id").isNotNull())
    )


def imputed_tests(draft: DataFrame) -> DataFrame:
    """Picks of known size with their missing physical tests estimated."""
    return impute_cascade(draft.dropna(subset=["height_inches", "weight"]), IMPUTATION)


def first_five_seasons(
    values: DataFrame, draft: DataFrame, as_of: int = AS_OF, train_until: int = TRAIN_UNTIL,
    leave_out: tuple[str, ...] = LISTED_TWICE,
) -> DataFrame:
    """Value of every drafted player over the first five seasons, projected where they are not over.

    Players in ``leave_out``, those whose drafts cannot be told apart, get no value.
    """
    facts = values.select("player_id", leading_year(F.col("year")).alias("year"), F.col("av").cast("double"))
    return cohort_projection(
        facts, draft.select("player_id", "season"), "player_id", "year", "av", "season", HORIZON, as_of, train_until, leave_out
    )


def model_rows(values: DataFrame, draft: DataFrame, careers: DataFrame, volume: str = "rush_att") -> DataFrame:
    """One row per drafted player with value, pick, measures and college career.

    Players of unknown value count as 0; those of negative value or without ``volume`` are left out.
    """
    known = clear_missing(values.select(F.col("player_id").alias("pfr_id"), "av"), ["av"])
    drafted = draft.select(
        F.col("pfr_player_id").alias("pfr_id"), F.col("cfb_player_id").alias("cfbref_id"), "season", "pick", "age", *MEASURES
    )
    rows = known.where(F.col("av") >= 0).join(drafted, "pfr_id").join(careers.where(F.col(volume) > 0), "cfbref_id")
    return keep_first(rows, ["cfbref_id"], [F.asc("pfr_id"), F.asc("season"), F.asc("pick")])


def predicted_classes(rows: DataFrame, features: str = "all") -> DataFrame:
    """Every draft class predicted from the other classes; ``features`` is a key of ``FEATURES``."""
    rows = settle(rows)
    if features == "all":
        rows = settle(held_out_composites(rows, "season", COMPOSITES, "av"))
    return leave_group_out(rows, "season", FEATURES[features], "av")


def ranked_classes(predicted: DataFrame) -> DataFrame:
    """Predicted classes with our ranking, the real one and the order of the picks."""
    return prediction_rankings(predicted, ["season"], "predicted", "av", "pick", "cfbref_id")


def class_scores(ranked: DataFrame) -> DataFrame:
    """Per class, tau and p-value of our ranking and of the draft order."""
    return ranking_report(ranked, ["season"])


def overall_scores(predicted: DataFrame) -> DataFrame:
    """Tau and p-value of both rankings over all classes together: the rankings within the classes, pooled."""
    return ranking_report(ranked_classes(predicted))


def whole_table_scores(predicted: DataFrame) -> DataFrame:
    """Tau and p-value of both rankings where all classes are ranked as one; equal values rank by the pick."""
    return ranking_report(prediction_rankings(predicted, [], "predicted", "av", "pick", "cfbref_id", "baseline"))


def projected_by_neighbors(rows: DataFrame, position: str, features: list[str]) -> DataFrame:
    """Value from the most similar players, with the settings of the position."""
    return neighbor_projection(rows, "cfbref_id", features, "av", **NEIGHBORS[position])


def stacked_model(rows: DataFrame, learner: Callable[[], object]) -> DataFrame:
    """One model per category of features, then a model on their scores and the age."""
    used = sorted({"age", *[c for cols in CATEGORIES.values() for c in cols]})
    return stacked_predict(scale_min_max(rows, used), CATEGORIES, "av", learner, also=("age",))
