"""Projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.functions.scalars import (
    euclidean, feet_inches, leading_year, number, prefix_match, un_min_max,
)
from almanac.operators.summary import scale_min_max, scale_z
from almanac.operators.joins import attach_stats
from almanac.operators.summary import column_ranges
from almanac.plans.catalog.registry import query, r, rounded


@query("SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS total FROM orders")
def project_and_rename(t):
    return t.orders.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").alias("total"),
    )


@query(f"""
    SELECT l_orderkey, l_linenumber, {r("l_extendedprice * (1 - l_discount)", 6)} AS net,
           {r("l_extendedprice * (1 - l_discount) * (1 + l_tax)", 6)} AS gross,
           {r("l_extendedprice * (1 - l_discount) / (l_extendedprice * (1 - l_discount) * (1 + l_tax))", 6)} AS net_share
    FROM lineitem
""")
def derived_columns(t):
    out = t.lineitem.withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    out = out.withColumn("gross", F.col("net") * (1 + F.col("l_tax")))
    out = out.withColumn("net_share", F.try_divide("net", "gross"))
    return out.select(
        "l_orderkey", "l_linenumber", *[rounded(c, 6).alias(c) for c in ("net", "gross", "net_share")]
    )


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def drop_column(t):
    return t.customer.drop("c_acctbal")


@query("SELECT s_suppkey, s_nationkey, s_acctbal, upper(s_name) AS label FROM supplier")
def replace_column(t):
    return t.supplier.withColumn("label", F.upper("s_name")).drop("s_name")


@query('SELECT n_nationkey AS "key", n_name AS "name", n_regionkey AS "region" FROM nation')
def rename_all_columns(t):
    return t.nation.toDF("key", "name", "region")


@query("SELECT p_partkey, p_size, p_retailprice FROM part")
def named_features(t):
    features = ["p_size", "p_retailprice"]
    return t.part.select("p_partkey", *features)


@query("""
    SELECT o_orderkey, substr(o_orderpriority, 3) AS priority, length(o_orderpriority)::INT AS size,
           regexp_replace(o_orderpriority, '[A-Z]', 'x') AS first_masked,
           regexp_replace(o_orderpriority, '[A-Z]', 'x', 'g') AS all_masked,
           o_orderstatus || o_orderpriority AS joined, concat_ws('/', o_orderstatus, o_orderpriority) AS path,
           try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE) AS level, try_cast(o_orderpriority AS DOUBLE) AS no_number
    FROM orders
""")
def text_functions(t):
    text = F.col("o_orderpriority")
    return t.orders.select(
        "o_orderkey", F.substring(text, 3, 100).alias("priority"), F.length(text).alias("size"),
        F.regexp_replace(text, r"^([^A-Z]*)[A-Z]", "$1x").alias("first_masked"),
        F.regexp_replace(text, "[A-Z]", "x").alias("all_masked"),
        F.concat("o_orderstatus", text).alias("joined"), F.concat_ws("/", "o_orderstatus", text).alias("path"),
        number(F.substring(text, 1, 1)).alias("level"), number(text).alias("no_number"),
    )


@query("""
    SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
           coalesce(CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 1 END, 9) AS code,
           greatest(year(o_orderdate), 1997)::INT AS clamped,
           year(o_orderdate)::INT AS lead_year
    FROM orders
""")
def conditional_values(t):
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    marked = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("*+"))
    return t.orders.select(
        "o_orderkey", F.when(price > 300000, "high").when(price > 100000, "mid").otherwise("low").alias("band"),
        F.coalesce(F.when(status == "F", 0).when(status == "O", 1), F.lit(9)).alias("code"),
        F.greatest(F.year("o_orderdate"), F.lit(1997)).alias("clamped"), leading_year(marked).alias("lead_year"),
    )


@query(f"""
    SELECT l_orderkey, l_linenumber, {r("l_quantity * l_quantity", 4)} AS squared,
           CASE WHEN l_discount <> 0 THEN {r("1 / l_discount", 4)} END AS reciprocal,
           {r("abs(l_tax - l_discount)", 6)} AS gap
    FROM lineitem
""")
def arithmetic(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", rounded(F.pow("l_quantity", F.lit(2.0)), 4).alias("squared"),
        rounded(F.try_divide(F.lit(1.0), F.col("l_discount")), 4).alias("reciprocal"),
        rounded(F.abs(F.col("l_tax") - F.col("l_discount")), 6).alias("gap"),
    )


@query("""
    SELECT p_partkey, CASE WHEN p_size > 3 THEN (4 + p_size // 12) * 12.0 + p_size % 12 END AS inches FROM part
""")
def heights_in_inches(t):
    text = F.format_string("%d-%d", 4 + F.floor(F.col("p_size") / 12).cast("int"), F.col("p_size") % 12)
    return t.part.select(
        "p_partkey", feet_inches(F.when(F.col("p_size") > 3, text).otherwise("unknown")).alias("inches")
    )


@query("""
    SELECT p.p_partkey, q.p_partkey AS other
    FROM part p JOIN part q ON p.p_partkey + 1 = q.p_partkey AND substr(p.p_brand, 1, 7) = substr(q.p_brand, 1, 7)
""")
def equal_prefixes(t):
    other = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_partkey").alias("other"),
                          F.col("p_brand").alias("other_brand"))
    both = t.part.join(other, "p_partkey")
    return both.where(prefix_match(F.col("p_brand"), F.col("other_brand"), 7)).select("p_partkey", "other")


@query(f"""
    SELECT c_custkey, {r("(c_acctbal - lo) / (hi - lo)", 6)} AS scaled, {r("c_acctbal", 6)} AS restored
    FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
""")
def min_max_scaled(t):
    scaled = scale_min_max(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"])
    out = attach_stats(scaled, column_ranges(t.customer, ["c_acctbal"]))
    restored = un_min_max(F.col("c_acctbal"), F.col("c_acctbal_min"), F.col("c_acctbal_max"))
    return out.select("c_custkey", rounded("c_acctbal", 6).alias("scaled"), rounded(restored, 6).alias("restored"))


@query(f"""
    SELECT l_orderkey, l_linenumber, {r("(l_quantity - mq) / sq", 6)} AS l_quantity, {r("(l_tax - mt) / st", 6)} AS l_tax
    FROM lineitem, (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq,
                           avg(l_tax) AS mt, stddev_samp(l_tax) AS st FROM lineitem)
""")
def z_scored(t):
    scaled = scale_z(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"])
    return scaled.select(
        "l_orderkey", "l_linenumber", rounded("l_quantity", 6).alias("l_quantity"), rounded("l_tax", 6).alias("l_tax")
    )


@query("SELECT p_partkey, unnest(range(1, p_size + 1))::INT AS step FROM part")
def integer_sequences(t):
    return t.part.select("p_partkey", F.explode(F.sequence(F.lit(1), F.col("p_size"))).alias("step"))


@query(f"""
    SELECT a.vec_id, {r("list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", 6)} AS distance
    FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id
""")
def distances_of_vectors(t):
    other = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(other, "vec_id").select(
        "vec_id", rounded(euclidean(F.col("embedding"), F.col("other")), 6).alias("distance")
    )
