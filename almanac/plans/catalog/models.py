"""Roll-ups, projections, imputation and prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators.holdout import (
    held_out_composites, leave_group_out, leave_group_out_ranges, leave_group_out_screen,
    refit_groups, stacked_linear,
)
from almanac.operators.impute import impute_cascade
from almanac.operators.boosted import leave_group_out_boosted
from almanac.operators.cells import knn_neighbors_in_cells
from almanac.operators.neighbors import knn_neighbors, knn_predict
from almanac.operators.rates import career_rollup, weighted_composite
from almanac.operators.settle import settle
from almanac.operators.summary import correlation_screen, scale_min_max
from almanac.plans.careers import adjusted_stats, cohort_projection, player_table
from almanac.plans.catalog.rankings import SQL_CUSTOMER_YEARS, customer_years, sql_tau
from almanac.plans.catalog.registry import query, r, rounded
from almanac.plans.reports import holdout_report, neighbor_projection


@query(f"""
    SELECT o_custkey, sum(l_quantity) AS l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice,
           {r("sum(l_discount * l_quantity) / sum(l_quantity)", 6)} AS l_discount,
           {r("sum(l_tax * l_extendedprice) / sum(l_extendedprice)", 6)} AS l_tax
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1
""")
def careers_rolled_up(t):
    lines = t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rows = t.orders.select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    out = career_rollup(
        rows, ["o_custkey"], ["l_quantity", "l_extendedprice"],
        {"l_discount": "l_quantity", "l_tax": "l_extendedprice"},
    )
    return out.select(
        "o_custkey", "l_quantity", rounded("l_extendedprice", 2).alias("l_extendedprice"),
        rounded("l_discount", 6).alias("l_discount"), rounded("l_tax", 6).alias("l_tax"),
    )


@query(f"""
    WITH years AS ({SQL_CUSTOMER_YEARS}),
         adjusted AS (SELECT *, (price / quantity - sum(price) OVER y / sum(quantity) OVER y) * quantity AS price_plus
                      FROM years WINDOW y AS (PARTITION BY order_year)),
         standing AS (SELECT year(o_orderdate)::INT AS order_year, o_custkey, count(*) AS orders FROM orders GROUP BY 1, 2),
         urgent AS (SELECT year(o_orderdate)::INT AS order_year, o_custkey, round(sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT'), 2) AS urgent
                    FROM orders GROUP BY 1, 2)
    SELECT order_year, o_custkey, {r("price_plus", 2)} AS price_plus, orders, urgent
    FROM adjusted JOIN standing USING (order_year, o_custkey) LEFT JOIN urgent USING (order_year, o_custkey)
""")
def season_table_adjusted(t):
    keys = ["order_year", "o_custkey"]
    orders = t.orders.select(F.year("o_orderdate").alias("order_year"), "o_custkey", "o_totalprice", "o_orderpriority")
    standing = orders.groupBy(*keys).agg(F.count("*").alias("orders"))
    urgent = orders.groupBy(*keys).agg(
        F.round(F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))), 2).alias("urgent")
    )
    adjusted = adjusted_stats(
        customer_years(t), standing, "order_year", keys, {"price_plus": ("price", "quantity")}
    )
    return player_table(adjusted, urgent, keys).select(
        *keys, rounded("price_plus", 2).alias("price_plus"), "orders", "urgent"
    )


def _sql_projection(horizon: int, as_of: int, train_until: int) -> str:
    strict = "CASE WHEN count_if({c} AND v IS NULL) = 0 THEN coalesce(sum(v) FILTER ({c}), 0) END"
    known = ", ".join(f"{strict.format(c=f'(age < {n})')} AS k{n}" for n in range(1, horizon))
    rest = ", ".join(f"{strict.format(c=f'(age >= {n} AND age < {horizon})')} AS t{n}" for n in range(1, horizon))
    lines = ", ".join(
        f"regr_slope(t{n}, k{n}) AS s{n}, regr_intercept(t{n}, k{n}) AS b{n}" for n in range(1, horizon)
    )
    cases = " ".join(
        f"WHEN d = {as_of + 1 - n} AND seen > 0 THEN so_far + b{n} + s{n} * so_far" for n in range(1, horizon)
    )
    return f"""
        WITH cohorts AS (SELECT c_custkey AS id, d FROM customer LEFT JOIN (
                 SELECT o_custkey, (min(year(o_orderdate)) FILTER (o_orderpriority = '1-URGENT'))::INT AS d FROM orders GROUP BY 1)
                 ON c_custkey = o_custkey),
             facts AS (SELECT o_custkey AS id, year(o_orderdate) AS y,
                              CASE WHEN o_orderstatus <> 'P' OR o_orderpriority <> '5-LOW' THEN o_totalprice END AS v FROM orders),
             aged AS (SELECT id, d, y, v, y - d AS age FROM facts JOIN cohorts USING (id)),
             totals AS (SELECT id, d, {known}, {rest}, {strict.format(c=f"(age < {horizon})")} AS whole,
                               {strict.format(c=f"(y <= {as_of})")} AS so_far, count_if(y <= {as_of}) AS seen, count_if(age < {horizon}) AS inside
                        FROM aged GROUP BY id, d),
             lines AS (SELECT {lines} FROM totals WHERE d <= {train_until}),
             valued AS (SELECT id, CASE WHEN d <= {train_until} AND inside > 0 THEN whole {cases} END AS v FROM totals, lines)
        SELECT cohorts.id, d, {r("v", 2)} AS v FROM cohorts LEFT JOIN valued ON cohorts.id = valued.id
    """


@query(_sql_projection(5, 2001, 1997))
def cohorts_projected(t):
    urgent = t.orders.groupBy("o_custkey").agg(
        F.min(F.when(F.col("o_orderpriority") == "1-URGENT", F.year("o_orderdate"))).alias("d")
    )
    cohorts = t.customer.select(F.col("c_custkey").alias("id")).join(
        urgent.withColumnRenamed("o_custkey", "id"), "id", "left"
    )
    known = (F.col("o_orderstatus") != "P") | (F.col("o_orderpriority") != "5-LOW")
    facts = t.orders.select(
        F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("y"), F.when(known, F.col("o_totalprice")).alias("v")
    )
    out = cohort_projection(facts, cohorts, "id", "y", "v", "d", horizon=5, as_of=2001, train_until=1997)
    return out.select("id", "d", rounded("v", 2).alias("v"))


_SQL_GAPS = """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
           CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS price,
           CASE WHEN l_linenumber NOT IN (2, 5) THEN l_discount END AS discount,
           CASE WHEN l_linenumber NOT IN (5, 6) THEN l_tax END AS tax
    FROM lineitem
"""


@query(f"""
    WITH gaps AS ({_SQL_GAPS}),
         one AS (SELECT regr_slope(price, l_quantity) AS s, regr_intercept(price, l_quantity) AS b,
                        regr_slope(tax, discount) AS ts, regr_intercept(tax, discount) AS tb FROM gaps),
         plane AS (SELECT (k1 * v2 - k2 * c) / (v1 * v2 - c * c) AS s1, (k2 * v1 - k1 * c) / (v1 * v2 - c * c) AS s2, *
                   FROM (SELECT avg(tax) AS my, avg(l_quantity) AS m1, avg(price) AS m2, var_samp(l_quantity) AS v1,
                                var_samp(price) AS v2, covar_samp(l_quantity, price) AS c,
                                covar_samp(tax, l_quantity) AS k1, covar_samp(tax, price) AS k2
                         FROM gaps WHERE tax IS NOT NULL AND price IS NOT NULL)),
         first AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, discount,
                          coalesce(price, b + s * l_quantity) AS price,
                          coalesce(tax, tb + ts * discount, my - s1 * m1 - s2 * m2 + s1 * l_quantity + s2 * price) AS tax
                   FROM gaps, one, plane),
         two AS (SELECT regr_slope(discount, tax) AS s, regr_intercept(discount, tax) AS b,
                        regr_slope(discount, price) AS ps, regr_intercept(discount, price) AS pb FROM first)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r("price", 2)} AS price,
           {r("coalesce(discount, b + s * tax, pb + ps * price)", 6)} AS discount, {r("tax", 6)} AS tax
    FROM first, two
""")
def gaps_filled_in_stages(t):
    lines = t.lineitem
    gaps = lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("price"),
        F.when(~F.col("l_linenumber").isin(2, 5), F.col("l_discount")).alias("discount"),
        F.when(~F.col("l_linenumber").isin(5, 6), F.col("l_tax")).alias("tax"),
    )
    out = impute_cascade(gaps, [
        {"price": [("l_quantity",)], "tax": [("discount",), ("l_quantity", "price")]},
        {"discount": [("tax",), ("price",)]},
    ])
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rounded("price", 2).alias("price"),
        rounded("discount", 6).alias("discount"), rounded("tax", 6).alias("tax"),
    )


@query(f"""
    SELECT l_orderkey, l_linenumber, {r("(q * rq + d * rd) / (rq + rd)", 6)} AS size, {r("x", 6)} AS charge
    FROM (SELECT l_orderkey, l_linenumber, (l_quantity - ql) / (qh - ql) AS q, (l_discount - dl) / (dh - dl) AS d,
                 (l_tax - tl) / (th - tl) AS x, rq, rd
          FROM lineitem, (SELECT min(l_quantity) AS ql, max(l_quantity) AS qh, min(l_discount) AS dl, max(l_discount) AS dh,
                                 min(l_tax) AS tl, max(l_tax) AS th, pow(corr(l_quantity, l_extendedprice), 2) AS rq,
                                 pow(corr(l_discount, l_extendedprice), 2) AS rd FROM lineitem))
""")
def composites_weighted(t):
    features = ["l_quantity", "l_discount", "l_tax"]
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", *features)
    weights = correlation_screen(lines, features, "l_extendedprice")
    out = weighted_composite(
        scale_min_max(lines, features), {"size": ["l_quantity", "l_discount"], "charge": ["l_tax"]}, weights
    )
    return out.select("l_orderkey", "l_linenumber", rounded("size", 6).alias("size"), rounded("charge", 6).alias("charge"))


_SQL_NEAREST = f"""
    SELECT vec_id, rn::INT AS rn, neighbor, distance, label FROM (
        SELECT a.vec_id, b.vec_id AS neighbor, b.label,
               list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance,
               row_number() OVER (PARTITION BY a.vec_id
                   ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rn
        FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
    WHERE rn <= 10
"""


@query(f"SELECT vec_id, rn, neighbor, {r('distance', 6)} AS distance FROM ({_SQL_NEAREST})")
def nearest_vectors(t):
    out = knn_neighbors(t.embeddings, "vec_id", ["embedding"], 10)
    return out.select("vec_id", "rn", "neighbor", rounded("distance", 6).alias("distance"))


@query(f"SELECT vec_id, rn, neighbor, {r('distance', 6)} AS distance FROM ({_SQL_NEAREST})")
def nearest_vectors_in_cells(t):
    """All embeddings through the tree of cells; equal to the exact search while 16 probes reach all cells (16,384 vectors)."""
    out = knn_neighbors_in_cells(t.embeddings, "vec_id", ["embedding"], 10)
    return out.select("vec_id", "rn", "neighbor", rounded("distance", 6).alias("distance"))


@query(f"""
    SELECT vec_id, {r("sum(label / distance) / sum(1 / distance)", 6)} AS predicted,
           max(neighbor) FILTER (rn = 1) AS comp_1, max(neighbor) FILTER (rn = 2) AS comp_2,
           max(neighbor) FILTER (rn = 3) AS comp_3
    FROM ({_SQL_NEAREST}) GROUP BY 1
""")
def labels_predicted_from_neighbors(t):
    out = knn_predict(t.embeddings, "vec_id", ["embedding"], "label", 10)
    return out.withColumn("predicted", rounded("predicted", 6))


_SQL_CAREERS = """
    SELECT c_custkey, c_acctbal, count(*)::DOUBLE AS orders, sum(o_totalprice) AS total
    FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2
"""


def careers(t):
    """Balance, number of orders and their total for every customer with orders."""
    customers = t.customer.select("c_custkey", "c_acctbal")
    return settle(
        customers.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey", "c_acctbal").agg(
            F.count("*").cast("double").alias("orders"), F.sum("o_totalprice").alias("total")
        )
    )


def _sql_projection_from_neighbors(x_weight: str, y_weight: str, k: int) -> str:
    distance = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
    return f"""
        WITH scaled AS (
                 SELECT c_custkey, total, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER () * {x_weight} AS x,
                        (orders - avg(orders) OVER ()) / stddev_samp(orders) OVER () * {y_weight} AS y FROM ({_SQL_CAREERS})),
             near AS (SELECT a.c_custkey, a.total AS own, b.c_custkey AS neighbor, b.total, {distance} AS distance,
                             row_number() OVER (PARTITION BY a.c_custkey ORDER BY {distance}, b.c_custkey) AS rn
                      FROM scaled a JOIN scaled b ON a.c_custkey <> b.c_custkey)
        SELECT c_custkey, {r("any_value(own)", 2)} AS total, {r("sum(total / distance) / sum(1 / distance)", 2)} AS predicted,
               max(neighbor) FILTER (rn = 1) AS comp_1
        FROM near WHERE rn <= {k} GROUP BY 1 HAVING min(distance) > 0
    """


def _projection(t, k, weighted):
    out = neighbor_projection(careers(t), "c_custkey", ["c_acctbal", "orders"], "total", k, comps=1, weighted=weighted)
    return out.select("c_custkey", rounded("total", 2).alias("total"), rounded("predicted", 2).alias("predicted"), "comp_1")


@query(_sql_projection_from_neighbors("1", "1", 15))
def totals_predicted_from_neighbors(t):
    return _projection(t, 15, False)


@query(_sql_projection_from_neighbors(
    "abs(corr(c_acctbal, total) OVER ()) * 100", "abs(corr(orders, total) OVER ()) * 100", 30
))
def totals_predicted_with_weights(t):
    return _projection(t, 30, True)


def order_sizes(t):
    """Year, price, quantity and number of lines of every order that has lines."""
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("quantity"), F.count("*").cast("double").alias("lines")
    )
    orders = t.orders.select("o_orderkey", F.year("o_orderdate").alias("order_year"), "o_totalprice")
    return settle(orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey"))


SQL_ORDER_SIZES = """
    SELECT o_orderkey, year(o_orderdate)::INT AS order_year, o_totalprice, quantity, lines FROM orders
    JOIN (SELECT l_orderkey, sum(l_quantity) AS quantity, count(*)::DOUBLE AS lines FROM lineitem GROUP BY 1)
      ON o_orderkey = l_orderkey
"""


@query(f"""
    WITH o AS ({SQL_ORDER_SIZES}), g AS (SELECT DISTINCT order_year FROM o),
         fits AS (SELECT g.order_year, regr_slope(o_totalprice, quantity) AS s, regr_intercept(o_totalprice, quantity) AS b
                  FROM g JOIN o ON g.order_year <> o.order_year GROUP BY 1)
    SELECT o_orderkey, {r("b + s * quantity", 2)} AS predicted FROM o JOIN fits USING (order_year)
""")
def years_held_out_one_feature(t):
    out = leave_group_out(order_sizes(t), "order_year", ["quantity"], "o_totalprice")
    return out.select("o_orderkey", rounded("predicted", 2).alias("predicted"))


@query(f"""
    WITH o AS ({SQL_ORDER_SIZES}), g AS (SELECT DISTINCT order_year FROM o),
         m AS (SELECT g.order_year, avg(o_totalprice) AS my, avg(quantity) AS m1, avg(lines) AS m2,
                      var_samp(quantity) AS v1, var_samp(lines) AS v2, covar_samp(quantity, lines) AS c,
                      covar_samp(o_totalprice, quantity) AS k1, covar_samp(o_totalprice, lines) AS k2
               FROM g JOIN o ON g.order_year <> o.order_year GROUP BY 1),
         fits AS (SELECT *, (k1 * v2 - k2 * c) / (v1 * v2 - c * c) AS s1, (k2 * v1 - k1 * c) / (v1 * v2 - c * c) AS s2 FROM m)
    SELECT o_orderkey, {r("my + s1 * (quantity - m1) + s2 * (lines - m2)", 2)} AS predicted FROM o JOIN fits USING (order_year)
""")
def years_held_out_two_features(t):
    out = leave_group_out(order_sizes(t), "order_year", ["quantity", "lines"], "o_totalprice")
    return out.select("o_orderkey", rounded("predicted", 2).alias("predicted"))


@query(f"""
    WITH o AS ({SQL_ORDER_SIZES}), g AS (SELECT DISTINCT order_year FROM o)
    SELECT g.order_year, min(quantity) AS quantity_min, max(quantity) AS quantity_max,
           min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max
    FROM g JOIN o ON g.order_year <> o.order_year GROUP BY 1
""")
def ranges_of_other_years(t):
    return leave_group_out_ranges(order_sizes(t), "order_year", ["quantity", "o_totalprice"])


_SQL_HELD_OUT = f"""
    WITH o AS ({SQL_ORDER_SIZES}), g AS (SELECT DISTINCT order_year FROM o),
         rest AS (SELECT g.order_year, min(quantity) AS ql, max(quantity) AS qh, min(lines) AS ll, max(lines) AS lh,
                         pow(corr(quantity, o_totalprice), 2) AS rq, pow(corr(lines, o_totalprice), 2) AS rl
                  FROM g JOIN o ON g.order_year <> o.order_year GROUP BY 1),
         whole AS (SELECT pow(corr(quantity, o_totalprice), 2) AS rq, pow(corr(lines, o_totalprice), 2) AS rl FROM o)
"""


@query(f"""
    {_SQL_HELD_OUT}
    SELECT order_year, {r("rq", 10)} AS quantity_r2, {r("rl", 10)} AS lines_r2 FROM rest
""")
def correlations_of_other_years(t):
    out = leave_group_out_screen(order_sizes(t), "order_year", ["quantity", "lines"], "o_totalprice")
    return out.select("order_year", rounded("quantity_r2", 10).alias("quantity_r2"), rounded("lines_r2", 10).alias("lines_r2"))


@query(f"""
    {_SQL_HELD_OUT}
    SELECT o_orderkey, {r("((quantity - ql) / (qh - ql) * rq + (lines - ll) / (lh - ll) * rl) / (rq + rl)", 6)} AS size
    FROM o JOIN rest USING (order_year)
""")
def composites_of_other_years(t):
    out = held_out_composites(order_sizes(t), "order_year", {"size": ["quantity", "lines"]}, "o_totalprice")
    return out.select("o_orderkey", rounded("size", 6).alias("size"))


@query(f"""
    {_SQL_HELD_OUT}
    SELECT o_orderkey, {r("((quantity - ql) / (qh - ql) * w.rq + (lines - ll) / (lh - ll) * w.rl) / (w.rq + w.rl)", 6)} AS size
    FROM o JOIN rest USING (order_year), whole w
""")
def composites_with_all_weights(t):
    out = held_out_composites(
        order_sizes(t), "order_year", {"size": ["quantity", "lines"]}, "o_totalprice", weights_of_all_rows=True
    )
    return out.select("o_orderkey", rounded("size", 6).alias("size"))


_SQL_HOLDOUT_RANKED = f"""
    SELECT order_year, row_number() OVER (PARTITION BY order_year ORDER BY predicted DESC, o_orderkey) AS our_ranking,
           row_number() OVER (PARTITION BY order_year ORDER BY o_totalprice DESC, predicted DESC, o_orderkey) AS real_ranking,
           row_number() OVER (PARTITION BY order_year ORDER BY lines, o_totalprice DESC, predicted DESC, o_orderkey)
               AS baseline_ranking
    FROM (SELECT o.*, b + s * quantity AS predicted FROM ({SQL_ORDER_SIZES}) o JOIN (
              SELECT g.order_year, regr_slope(o_totalprice, quantity) AS s, regr_intercept(o_totalprice, quantity) AS b
              FROM (SELECT DISTINCT order_year FROM ({SQL_ORDER_SIZES})) g JOIN ({SQL_ORDER_SIZES}) o
                ON g.order_year <> o.order_year GROUP BY 1) USING (order_year))
"""


@query(f"""
    SELECT order_year, a.n, our_tau, baseline_tau
    FROM (SELECT g AS order_year, n, our_tau FROM (
              {sql_tau(_SQL_HOLDOUT_RANKED, "our_ranking", "real_ranking", "order_year", "our_tau")})) a
    JOIN (SELECT g AS order_year, baseline_tau FROM (
              {sql_tau(_SQL_HOLDOUT_RANKED, "baseline_ranking", "real_ranking", "order_year", "baseline_tau")})) b
    USING (order_year)
""")
def holdout_rankings_scored(t):
    out = holdout_report(order_sizes(t), "order_year", ["quantity"], "o_totalprice", "lines", "o_orderkey")
    return out.select(
        "order_year", "n", rounded("our_tau", 9).alias("our_tau"), rounded("baseline_tau", 9).alias("baseline_tau")
    )


@query()
def years_held_out_boosted_trees(t):
    """Boosted trees for every year from one pass over the rows."""
    out = leave_group_out_boosted(order_sizes(t), "order_year", ["quantity", "lines"], "o_totalprice")
    return out.select("o_orderkey", "order_year", "predicted")


@query(f"""
    WITH o AS (SELECT *, o_orderkey % 5 AS fold FROM ({SQL_ORDER_SIZES})),
         f AS (SELECT a.fold, regr_slope(o_totalprice, quantity) AS qs, regr_intercept(o_totalprice, quantity) AS qb,
                      regr_slope(o_totalprice, lines) AS ls, regr_intercept(o_totalprice, lines) AS lb
               FROM (SELECT DISTINCT fold FROM o) a JOIN o ON a.fold <> o.fold GROUP BY 1),
         s AS (SELECT o.*, qb + qs * quantity AS v, lb + ls * lines AS d FROM o JOIN f USING (fold)),
         m AS (SELECT avg(o_totalprice) AS my, avg(v) AS m1, avg(d) AS m2, var_samp(v) AS v1, var_samp(d) AS v2,
                      covar_samp(v, d) AS c, covar_samp(o_totalprice, v) AS k1, covar_samp(o_totalprice, d) AS k2 FROM s)
    SELECT o_orderkey, {r("v", 3)} AS volume_rating, {r("d", 3)} AS detail_rating,
           {r("my + (k1 * v2 - k2 * c) / (v1 * v2 - c * c) * (v - m1) + (k2 * v1 - k1 * c) / (v1 * v2 - c * c) * (d - m2)", 3)} AS predicted
    FROM s, m
""")
def categories_stacked(t):
    """Ratings from the other four folds, and a model on the ratings, all from one aggregate."""
    out = stacked_linear(
        order_sizes(t), {"volume": ["quantity"], "detail": ["lines"]}, "o_totalprice", F.col("o_orderkey") % 5
    )
    return out.select("o_orderkey", *[rounded(c, 3).alias(c) for c in ("volume_rating", "detail_rating", "predicted")])



@query(f"""
    WITH o AS ({SQL_ORDER_SIZES}),
         p AS (SELECT *, CASE WHEN order_year IN (1996, 1998, 2000) THEN 0 ELSE quantity * 1000 END AS predicted FROM o)
    SELECT o_orderkey, order_year, CASE WHEN order_year IN (1996, 1998, 2000) THEN quantity * 500 ELSE predicted END AS predicted FROM p
""")
def failed_groups_refitted(t):
    failed = F.col("order_year").isin(1996, 1998, 2000)
    first = order_sizes(t).select(
        "o_orderkey", "order_year", "quantity", F.when(failed, 0.0).otherwise(F.col("quantity") * 1000).alias("predicted")
    )
    out = refit_groups(first, "order_year", lambda rows: rows.withColumn("predicted", F.col("quantity") * 500))
    return out.select("o_orderkey", "order_year", "predicted")
