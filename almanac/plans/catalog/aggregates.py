"""Aggregates and column statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.functions.aggregates import group_rate, strict_sum, weighted_mean
from almanac.operators.summary import (
    column_ranges, column_spread, correlation_screen, histogram, histogram_chosen, ols1, ols2, weight_features,
)
from almanac.plans.catalog.filters import SQL_CUSTOMERS_WITH_ORDERS, customers_with_orders
from almanac.plans.catalog.registry import query, r, rounded


@query("""
    SELECT l_suppkey, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS price, count(*) AS n
    FROM lineitem GROUP BY 1
""")
def grouped_sums(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        rounded(F.sum("l_quantity"), 2).alias("quantity"), rounded(F.sum("l_extendedprice"), 2).alias("price"),
        F.count("*").alias("n"),
    )


@query(f"""
    SELECT c_nationkey, CASE WHEN count(*) = count(o_totalprice) THEN round(sum(o_totalprice), 2) END AS total,
           CASE WHEN count_if(c_acctbal > 7000) = count(CASE WHEN c_acctbal > 7000 THEN o_totalprice END)
                THEN coalesce(round(sum(CASE WHEN c_acctbal > 7000 THEN o_totalprice END), 2), 0) END AS total_rich,
           CASE WHEN count_if(c_acctbal > 1e9) = 0 THEN 0.0 END AS total_nobody
    FROM ({SQL_CUSTOMERS_WITH_ORDERS}) GROUP BY 1
""")
def strict_sums(t):
    price, balance = F.col("o_totalprice"), F.col("c_acctbal")
    return customers_with_orders(t).groupBy("c_nationkey").agg(
        rounded(strict_sum(price), 2).alias("total"), rounded(strict_sum(price, balance > 7000), 2).alias("total_rich"),
        strict_sum(price, balance > 1e9).alias("total_nobody"),
    )


@query(f"""
    SELECT l_suppkey, {r("sum(l_discount * l_quantity) / sum(l_quantity)", 6)} AS discount FROM lineitem GROUP BY 1
""")
def weighted_means(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        rounded(weighted_mean(F.col("l_discount"), F.col("l_quantity")), 6).alias("discount")
    )


@query(f"""
    SELECT year(l_shipdate)::INT AS ship_year, {r("sum(l_extendedprice) / sum(l_quantity)", 6)} AS price_per_unit
    FROM lineitem GROUP BY 1
""")
def rates_of_totals(t):
    return t.lineitem.groupBy(F.year("l_shipdate").alias("ship_year")).agg(
        rounded(group_rate(F.col("l_extendedprice"), F.col("l_quantity")), 6).alias("price_per_unit")
    )


@query(f"SELECT c_mktsegment, {r('avg(c_acctbal)', 6)} AS mean FROM customer GROUP BY 1")
def group_means(t):
    return t.customer.groupBy("c_mktsegment").agg(rounded(F.avg("c_acctbal"), 6).alias("mean"))


@query("""
    SELECT coalesce(round(sum(o_totalprice), 2), 0) AS total, count(*) AS n FROM orders WHERE o_totalprice < 0
""")
def totals_of_no_rows(t):
    rows = t.orders.where(F.col("o_totalprice") < 0)
    return rows.agg(rounded(strict_sum(F.col("o_totalprice")), 2).alias("total"), F.count("*").alias("n"))


@query("""
    SELECT min(l_quantity) AS l_quantity_min, min(l_discount) AS l_discount_min, min(l_extendedprice) AS l_extendedprice_min,
           max(l_quantity) AS l_quantity_max, max(l_discount) AS l_discount_max, max(l_extendedprice) AS l_extendedprice_max
    FROM lineitem
""")
def ranges_of_columns(t):
    return column_ranges(t.lineitem, ["l_quantity", "l_discount", "l_extendedprice"])


@query(f"""
    SELECT {r("avg(l_quantity)", 6)} AS l_quantity_mean, {r("avg(l_discount)", 6)} AS l_discount_mean,
           {r("stddev_samp(l_quantity)", 6)} AS l_quantity_sd, {r("stddev_samp(l_discount)", 6)} AS l_discount_sd
    FROM lineitem
""")
def spread_of_columns(t):
    out = column_spread(t.lineitem, ["l_quantity", "l_discount"])
    return out.select(*[rounded(c, 6).alias(c) for c in out.columns])


_SQL_SCREEN = " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {r('r', 8)} AS r, {r('r * r', 8)} AS r_squared, {r('abs(r)', 8)} AS r_abs "
    f"FROM (SELECT corr({c}, l_extendedprice) AS r FROM lineitem)"
    for c in ("l_quantity", "l_discount", "l_tax")
)


@query(_SQL_SCREEN)
def correlations_with_target(t):
    out = correlation_screen(t.lineitem, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return out.select("variable", *[rounded(c, 8).alias(c) for c in ("r", "r_squared", "r_abs")])


@query(f"""
    SELECT {r("corr(n_chars, quality)", 8)} AS quality, {r("corr(n_chars, toxic)", 8)} AS toxic
    FROM documents JOIN labels USING (doc_id)
""")
def correlation_of_two_columns(t):
    both = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    return both.agg(
        rounded(F.corr("n_chars", "quality"), 8).alias("quality"), rounded(F.corr("n_chars", "toxic"), 8).alias("toxic")
    )


@query(f"""
    SELECT l_suppkey, {r("regr_slope(l_extendedprice, l_quantity)", 4)} AS slope,
           {r("regr_intercept(l_extendedprice, l_quantity)", 4)} AS intercept,
           {r("regr_r2(l_extendedprice, l_quantity)", 6)} AS r2, regr_count(l_extendedprice, l_quantity)::BIGINT AS n
    FROM lineitem GROUP BY 1
""")
def lines_fitted_per_group(t):
    out = ols1(t.lineitem, "l_extendedprice", "l_quantity", ["l_suppkey"])
    return out.select(
        "l_suppkey", rounded("slope", 4).alias("slope"), rounded("intercept", 4).alias("intercept"),
        rounded("r2", 6).alias("r2"), "n",
    )


@query(f"""
    SELECT {r("slope1", 6)} AS slope1, {r("slope2", 6)} AS slope2, {r("my - slope1 * m1 - slope2 * m2", 4)} AS intercept, n
    FROM (SELECT (k1 * v2 - k2 * c) / (v1 * v2 - c * c) AS slope1, (k2 * v1 - k1 * c) / (v1 * v2 - c * c) AS slope2, *
          FROM (SELECT avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2, count(*) AS n,
                       var_samp(l_quantity) AS v1, var_samp(l_discount) AS v2, covar_samp(l_quantity, l_discount) AS c,
                       covar_samp(l_extendedprice, l_quantity) AS k1, covar_samp(l_extendedprice, l_discount) AS k2
                FROM lineitem WHERE l_tax > 0))
""")
def plane_fitted(t):
    # Rows without a tax miss the target, so the fit leaves them out.
    rows = t.lineitem.withColumn("price", F.when(F.col("l_tax") > 0, F.col("l_extendedprice")))
    out = ols2(rows, "price", "l_quantity", "l_discount")
    return out.select(
        rounded("slope1", 6).alias("slope1"), rounded("slope2", 6).alias("slope2"),
        rounded("intercept", 4).alias("intercept"), "n",
    )


@query(f"""
    SELECT o_custkey, {r("avg(o_totalprice)", 7)} AS mean FROM orders GROUP BY 1 HAVING avg(o_totalprice) > 250000
""")
def groups_by_their_mean(t):
    means = t.orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean"))
    return means.where(F.col("mean") > 250000).select("o_custkey", rounded("mean", 7).alias("mean"))


@query(f"""
    SELECT bin, {r("lo + width * (bin - 1)", 4)} AS "from", {r("lo + width * bin", 4)} AS "to", count(*) AS n FROM (
        SELECT least(greatest(ceil((o_totalprice - lo) / width), 1), 12)::INT AS bin, lo, width
        FROM orders, (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 12 AS width FROM orders))
    GROUP BY bin, lo, width
""")
def histogram_of_column(t):
    out = histogram(t.orders, "o_totalprice", 12)
    return out.select("bin", rounded("from", 4).alias("from"), rounded("to", 4).alias("to"), "n")


@query(f"""
    WITH s AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / ceil(log2(count(*)) + 1) AS width FROM lineitem),
         p AS (SELECT *, power(10.0, floor(log10(width))) AS ten FROM s),
         u AS (SELECT *, ten * CASE WHEN width <= 1.4 * ten THEN 1 WHEN width <= 2.8 * ten THEN 2 WHEN width <= 7 * ten THEN 5 ELSE 10 END AS step FROM p),
         f AS (SELECT step, floor(round(lo / step, 9)) AS first FROM u)
    SELECT bin, {r("(bin + first - 1) * step", 6)} AS "from", {r("(bin + first) * step", 6)} AS "to", count(*) AS n
    FROM (SELECT greatest(ceil(round(l_extendedprice / step, 9)) - first, 1)::INT AS bin, first, step FROM lineitem, f)
    GROUP BY bin, first, step
""")
def histogram_with_chosen_breaks(t):
    out = histogram_chosen(t.lineitem, "l_extendedprice")
    return out.select("bin", rounded("from", 6).alias("from"), rounded("to", 6).alias("to"), "n")


@query(f"""
    SELECT l_orderkey, l_linenumber, {r("(l_quantity - mq) / sq * abs(rq) * 100", 6)} AS l_quantity,
           {r("(l_discount - md) / sd * abs(rd) * 100", 6)} AS l_discount
    FROM lineitem, (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq, corr(l_quantity, l_extendedprice) AS rq,
                           avg(l_discount) AS md, stddev_samp(l_discount) AS sd, corr(l_discount, l_extendedprice) AS rd
                    FROM lineitem)
""")
def features_weighted_by_correlation(t):
    out = weight_features(
        t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice"),
        ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", exclude=("l_tax",),
    )
    return out.select(
        "l_orderkey", "l_linenumber", rounded("l_quantity", 6).alias("l_quantity"),
        rounded("l_discount", 6).alias("l_discount"),
    )
