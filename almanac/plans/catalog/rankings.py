"""Adjusted rates, rankings and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators.kendall import kendall_tau
from almanac.operators.numbering import Down
from almanac.operators.ranking import rank_within
from almanac.operators.rates import above_average, index_to_mean, index_to_rate
from almanac.operators.settle import settle
from almanac.plans.catalog.registry import query, r, rounded
from almanac.plans.reports import prediction_rankings, ranking_report


def customer_years(t):
    """Quantity and price per customer and order year; the only pass over the order lines."""
    orders = t.orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("order_year"))
    lines = t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice")
    return settle(
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("order_year", "o_custkey")
        .agg(F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"))
    )


SQL_CUSTOMER_YEARS = """
    SELECT year(o_orderdate)::INT AS order_year, o_custkey, sum(l_quantity) AS quantity, sum(l_extendedprice) AS price
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2
"""


@query(f"""
    SELECT order_year, o_custkey, quantity, {r("(price / quantity - rate) * quantity", 2)} AS price_plus
    FROM (SELECT *, sum(price) OVER y / sum(quantity) OVER y AS rate FROM ({SQL_CUSTOMER_YEARS})
          WINDOW y AS (PARTITION BY order_year))
""")
def amount_above_average(t):
    out = above_average(customer_years(t), {"price_plus": ("price", "quantity")}, ["order_year"])
    return out.select("order_year", "o_custkey", "quantity", rounded("price_plus", 2).alias("price_plus"))


@query(f"""
    SELECT order_year, o_custkey, {r("100 * (price / quantity) / rate", 6)} AS price_index
    FROM (SELECT *, sum(price) OVER y / sum(quantity) OVER y AS rate FROM ({SQL_CUSTOMER_YEARS})
          WINDOW y AS (PARTITION BY order_year))
""")
def index_against_rate(t):
    out = index_to_rate(customer_years(t), {"price_index": ("price", "quantity")}, ["order_year"])
    return out.select("order_year", "o_custkey", rounded("price_index", 6).alias("price_index"))


@query(f"""
    SELECT o_orderkey, {r("100 * o_totalprice / avg(o_totalprice) OVER (PARTITION BY year(o_orderdate))", 6)} AS o_totalprice_plus
    FROM orders
""")
def index_against_mean(t):
    orders = t.orders.select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("order_year"))
    out = index_to_mean(orders, ["o_totalprice"], ["order_year"])
    return out.select("o_orderkey", rounded("o_totalprice_plus", 6).alias("o_totalprice_plus"))


def customer_scores(t):
    """Balance, order total and key of every customer: a prediction, an outcome and a baseline."""
    totals = t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("orders"))
    return settle(
        t.customer.join(totals, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select("c_nationkey", "c_custkey", "c_acctbal", "c_mktsegment",
                F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("orders", F.lit(0)).alias("orders"))
    )


SQL_CUSTOMER_SCORES = """
    SELECT c_nationkey, c_custkey, c_acctbal, c_mktsegment, coalesce(total, 0) AS total, coalesce(orders, 0) AS orders
    FROM customer LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS orders
                             FROM orders GROUP BY 1) ON c_custkey = o_custkey
"""

# The outcome counts orders, so that it has ties.
_SQL_RANKED = f"""
    SELECT c_nationkey, c_custkey,
           row_number() OVER (PARTITION BY {{by}} ORDER BY c_acctbal DESC, c_custkey) AS our_ranking,
           row_number() OVER (PARTITION BY {{by}} ORDER BY orders DESC, c_acctbal DESC, c_custkey) AS real_ranking,
           row_number() OVER (PARTITION BY {{by}} ORDER BY total, orders DESC, c_acctbal DESC, c_custkey) AS baseline_ranking
    FROM ({SQL_CUSTOMER_SCORES})
"""


def _ranked(t, by, outcome_ties="prediction"):
    return prediction_rankings(customer_scores(t), by, "c_acctbal", "orders", "total", "c_custkey", outcome_ties).select(
        "c_nationkey", "c_custkey", "our_ranking", "real_ranking", "baseline_ranking"
    )


@query(_SQL_RANKED.format(by="c_nationkey"))
def rankings_per_group(t):
    return _ranked(t, ["c_nationkey"])


@query(_SQL_RANKED.format(by="1"))
def rankings_overall(t):
    return _ranked(t, [])


_SQL_RANKED_BY_BASELINE = f"""
    SELECT c_nationkey, c_custkey,
           row_number() OVER ({{by}} ORDER BY c_acctbal DESC, c_custkey) AS our_ranking,
           row_number() OVER ({{by}} ORDER BY orders DESC, total, c_acctbal DESC, c_custkey) AS real_ranking,
           row_number() OVER ({{by}} ORDER BY total, c_acctbal DESC, c_custkey) AS baseline_ranking
    FROM ({SQL_CUSTOMER_SCORES})
"""


@query(_SQL_RANKED_BY_BASELINE.format(by=""))
def rankings_overall_by_baseline(t):
    """Equal outcomes rank by the baseline, as where a table sorted by the baseline is sorted again."""
    return _ranked(t, [], "baseline")


@query(_SQL_RANKED_BY_BASELINE.format(by="PARTITION BY c_nationkey"))
def rankings_per_group_by_baseline(t):
    return _ranked(t, ["c_nationkey"], "baseline")


@query("""
    SELECT l_orderkey, l_linenumber, row_number() OVER (
        ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS place
    FROM lineitem
""")
def lines_ranked_overall(t):
    tie = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"]
    lines = t.lineitem.select("l_extendedprice", *tie)
    out = rank_within(lines, [], {"place": [Down("l_extendedprice"), *tie]})
    return out.select("l_orderkey", "l_linenumber", "place")


def sql_tau(table: str, a: str, b: str, by: str, tau: str = "tau") -> str:
    """Tau-b by comparing all pairs of distinct values, weighted by their row counts."""
    return f"""
        WITH cells AS (SELECT {by} AS g, {a} AS x, {b} AS y, count(*) AS w FROM ({table}) GROUP BY 1, 2, 3),
             size AS (SELECT g, sum(w) AS n FROM cells GROUP BY 1),
             tx AS (SELECT g, sum(w * (w - 1) / 2) AS nx FROM (SELECT g, x, sum(w) AS w FROM cells GROUP BY 1, 2) GROUP BY 1),
             ty AS (SELECT g, sum(w * (w - 1) / 2) AS ny FROM (SELECT g, y, sum(w) AS w FROM cells GROUP BY 1, 2) GROUP BY 1),
             pairs AS (SELECT p.g, sum(p.w * q.w * sign(p.x - q.x) * sign(p.y - q.y)) / 2 AS s
                       FROM cells p JOIN cells q ON p.g = q.g GROUP BY 1)
        SELECT g, n::BIGINT AS n, {r("s / sqrt((n * (n - 1) / 2 - nx) * (n * (n - 1) / 2 - ny))", 9)} AS {tau}
        FROM size JOIN tx USING (g) JOIN ty USING (g) JOIN pairs USING (g)
    """


@query(f"""
    SELECT g AS c_nationkey, n, tau FROM ({sql_tau(SQL_CUSTOMER_SCORES, "c_acctbal", "total", "c_nationkey")})
""")
def kendall_per_group(t):
    out = kendall_tau(customer_scores(t), "c_acctbal", "total", ["c_nationkey"])
    return out.select("c_nationkey", "n", rounded("tau", 9).alias("tau"))


@query(f"""
    SELECT n, tau FROM ({sql_tau(SQL_CUSTOMER_SCORES, "c_acctbal", "orders", "1")})
""")
def kendall_overall(t):
    return kendall_tau(customer_scores(t), "c_acctbal", "orders").select("n", rounded("tau", 9).alias("tau"))


@query(f"""
    SELECT g AS l_returnflag, n, tau FROM ({sql_tau("SELECT * FROM lineitem", "l_quantity", "l_discount", "l_returnflag")})
""")
def kendall_with_many_ties(t):
    out = kendall_tau(t.lineitem, "l_quantity", "l_discount", ["l_returnflag"])
    return out.select("l_returnflag", "n", rounded("tau", 9).alias("tau"))


# All pairs of 60,000 rows are too many for SQL, but quantities are few: for each price and quantity, count the
# rows of that quantity below and above the price, and compare every row with those counts.
_SQL_ORDER_LINES = f"""
    WITH cells AS (SELECT l_quantity AS x, l_extendedprice AS y, count(*) AS w FROM lineitem GROUP BY 1, 2),
         grid AS (SELECT a.x, b.y, coalesce(c.w, 0) AS w FROM (SELECT DISTINCT x FROM cells) a
                  CROSS JOIN (SELECT DISTINCT y FROM cells) b LEFT JOIN cells c ON a.x = c.x AND b.y = c.y),
         counted AS (SELECT x, y, sum(w) OVER (PARTITION BY x ORDER BY y) - w AS below,
                            sum(w) OVER (PARTITION BY x) - sum(w) OVER (PARTITION BY x ORDER BY y) AS above FROM grid),
         score AS (SELECT sum(cells.w * sign(cells.x - counted.x) * (below - above)) / 2 AS s
                   FROM cells JOIN counted ON cells.y = counted.y),
         tx AS (SELECT sum(t * (t - 1)) AS x2, sum(t * (t - 1) * (t - 2)) AS x3, sum(t * (t - 1) * (2 * t + 5)) AS xv
                FROM (SELECT sum(w)::DOUBLE AS t FROM cells GROUP BY x)),
         ty AS (SELECT sum(t * (t - 1)) AS y2, sum(t * (t - 1) * (t - 2)) AS y3, sum(t * (t - 1) * (2 * t + 5)) AS yv
                FROM (SELECT sum(w)::DOUBLE AS t FROM cells GROUP BY y)),
         size AS (SELECT count(*)::DOUBLE AS n FROM lineitem)
    SELECT n::BIGINT AS n, {r("s / sqrt((n * (n - 1) - x2) / 2 * (n * (n - 1) - y2) / 2)", 9)} AS tau,
           {r("s / sqrt((n * (n - 1) * (2 * n + 5) - xv - yv) / 18 + x2 * y2 / (2 * n * (n - 1))"
              " + x3 * y3 / (9 * n * (n - 1) * (n - 2)))", 9)} AS z
    FROM score, tx, ty, size
"""


@query(_SQL_ORDER_LINES)
def kendall_of_order_lines(t):
    """All order lines as one group."""
    out = kendall_tau(t.lineitem, "l_quantity", "l_extendedprice")
    return out.select("n", *[rounded(c, 9).alias(c) for c in ("tau", "z")])


@query(_SQL_ORDER_LINES)
def kendall_of_order_lines_in_strips(t):
    """The same in strips of a thousandth of the usual size, so that the grid of strips is cut again."""
    out = kendall_tau(t.lineitem, "l_quantity", "l_extendedprice", strip_rows=1 << 10)
    return out.select("n", *[rounded(c, 9).alias(c) for c in ("tau", "z")])


@query(f"""
    SELECT c_nationkey, a.n, our_tau, baseline_tau
    FROM (SELECT g AS c_nationkey, n, our_tau FROM (
              {sql_tau(_SQL_RANKED.format(by="c_nationkey"), "our_ranking", "real_ranking", "c_nationkey", "our_tau")})) a
    JOIN (SELECT g AS c_nationkey, baseline_tau FROM (
              {sql_tau(_SQL_RANKED.format(by="c_nationkey"), "baseline_ranking", "real_ranking", "c_nationkey", "baseline_tau")})) b
    USING (c_nationkey)
""")
def rankings_scored(t):
    out = ranking_report(_ranked(t, ["c_nationkey"]), ["c_nationkey"])
    return out.select(
        "c_nationkey", "n", rounded("our_tau", 9).alias("our_tau"), rounded("baseline_tau", 9).alias("baseline_tau")
    )


def _sql_p_value(tau: str) -> str:
    """Two-sided p-value without ties: exact below 50 rows, else by the series of the error function."""
    agree = f"round(({tau} + 1) * n * (n - 1) / 4)::INT"
    up_to = "coalesce((SELECT sum(p) FROM orders_of o WHERE o.n = t.n AND o.k <= {0}), 0)"
    x = f"abs({tau}) * n * (n - 1) / 2 / sqrt(n * (n - 1) * (2 * n + 5) / 18) / sqrt(2)"
    x = f"greatest({x}, 1e-12)"
    term = f"exp(s.k * ln(4) + lgamma(s.k + 1) + (2 * s.k + 1) * ln({x}) - lgamma(2 * s.k + 2) - {x} * {x})"
    series = f"(SELECT sum({term}) FROM (SELECT unnest(range(0, 400)) AS k) s)"
    return f"""CASE WHEN n < 50 THEN least(1, 2 * least({up_to.format(agree)}, 1 - {up_to.format(agree + " - 1")}))
                    ELSE 1 - 2 / sqrt(pi()) * {series} END"""


@query(f"""
    WITH RECURSIVE orders_of AS (
             SELECT 1 AS n, 0 AS k, 1.0::DOUBLE AS p
             UNION ALL
             SELECT n + 1, k + j, sum(p) / (n + 1)
             FROM (SELECT n, k, p, unnest(range(0, n + 1))::INT AS j FROM orders_of WHERE n < 49) GROUP BY 1, 2, n),
         t AS (SELECT a.c_nationkey, a.n, our_tau, baseline_tau
               FROM (SELECT g AS c_nationkey, n, our_tau FROM (
                   {sql_tau(_SQL_RANKED.format(by="c_nationkey"), "our_ranking", "real_ranking", "c_nationkey", "our_tau")})) a
               JOIN (SELECT g AS c_nationkey, baseline_tau FROM (
                   {sql_tau(_SQL_RANKED.format(by="c_nationkey"), "baseline_ranking", "real_ranking", "c_nationkey", "baseline_tau")})) b
               USING (c_nationkey))
    SELECT c_nationkey, n, {r(_sql_p_value("our_tau"), 6)} AS our_p_value, {r(_sql_p_value("baseline_tau"), 6)} AS baseline_p_value
    FROM t
""")
def rankings_scored_with_p_values(t):
    out = ranking_report(_ranked(t, ["c_nationkey"]), ["c_nationkey"])
    return out.select(
        "c_nationkey", "n", rounded("our_p_value", 6).alias("our_p_value"),
        rounded("baseline_p_value", 6).alias("baseline_p_value"),
    )
