import pytest
from pyspark.sql import functions as F

from almanac.functions import (
    clear_missing, euclidean, feet_inches, group_rate, leading_year, link_id, min_max, number, prefix_match,
    strict_sum, un_min_max, weighted_mean, z_score,
)


def test_strict_sum_propagates_missing_and_is_zero_for_nothing(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 1), ("a", 2.0, 2), ("b", 1.0, 1), ("b", None, 2)], "g string, v double, y int"
    )
    rows = df.groupBy("g").agg(
        strict_sum(F.col("v")).alias("all"), strict_sum(F.col("v"), F.col("y") == 1).alias("first"),
        strict_sum(F.col("v"), F.col("y") > 5).alias("none"),
    ).orderBy("g").collect()
    assert [tuple(r) for r in rows] == [("a", 3.0, 1.0, 0.0), ("b", None, 1.0, 0.0)]
    assert df.where("y > 5").agg(strict_sum(F.col("v"))).first()[0] == 0


def test_rates_with_zero_denominators(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("b", 4.0, 2.0), ("b", 1.0, 3.0)], "g string, x double, w double")
    rows = df.groupBy("g").agg(
        group_rate(F.col("x"), F.col("w")), weighted_mean(F.col("x"), F.col("w"))
    ).orderBy("g").collect()
    assert tuple(rows[0])[1:] == (None, None)
    assert tuple(rows[1])[1:] == pytest.approx((1.0, 11 / 5))


def test_missing_is_null_and_nan(spark):
    df = spark.createDataFrame([(1, None, 2), (2, float("nan"), None)], "id int, x double, n int")
    assert [tuple(r) for r in clear_missing(df).orderBy("id").collect()] == [(1, 0.0, 2), (2, 0.0, 0)]


def test_text_and_scaling(spark):
    row = spark.createDataFrame(
        [(" 4.5 ", "n/a", "6-2", "tall", "1999*+", "/players/A/AbcDe00.htm", "Alabama", "Alab. A&M")],
        "a string, b string, h string, t string, y string, l string, c1 string, c2 string",
    ).select(
        number(F.col("a")), number(F.col("b")), feet_inches(F.col("h")), feet_inches(F.col("t")),
        leading_year(F.col("y")), link_id(F.col("l"), 11), prefix_match(F.col("c1"), F.col("c2"), 4),
        min_max(F.lit(3.0), F.lit(1.0), F.lit(5.0)), min_max(F.lit(3.0), F.lit(3.0), F.lit(3.0)),
        un_min_max(F.lit(0.5), F.lit(1.0), F.lit(5.0)), z_score(F.lit(3.0), F.lit(1.0), F.lit(0.0)),
        euclidean(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))),
    ).first()
    assert tuple(row) == (4.5, None, 74.0, None, 1999, "AbcDe00", True, 0.5, None, 3.0, None, 5.0)
