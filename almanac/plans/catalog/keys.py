"""First rows, repeated keys, sorting and stacking."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators.keys import (
    first_by, first_n, keep_first, repeated_keys, replace_groups, split_rows, union_all,
)
from almanac.plans.catalog.filters import SQL_CUSTOMERS_WITH_ORDERS, customers_with_orders
from almanac.plans.catalog.registry import query


@query("""
    SELECT o_custkey, o_orderkey, o_totalprice FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
    WHERE rn = 1
""")
def first_row_per_key(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return keep_first(rows, ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")]).drop("o_orderdate")


@query("""
    SELECT o_custkey, o_orderkey FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
    WHERE rn <= 4
""")
def first_four_per_key(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return first_n(rows, ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], 4).drop("o_orderdate")


@query("""
    SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1
""")
def first_value_per_key(t):
    return first_by(t.orders, ["o_custkey"], "o_orderkey", F.struct("o_orderdate", "o_orderkey"))


@query(f"""
    WITH rows AS ({SQL_CUSTOMERS_WITH_ORDERS})
    SELECT c_custkey, c_nationkey, o_orderstatus FROM (
        SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_acctbal, o_orderstatus) AS n FROM rows) WHERE n > 1
""")
def rows_with_repeated_keys(t):
    rows = customers_with_orders(t)
    return repeated_keys(rows, ["c_nationkey", "c_acctbal", "o_orderstatus"]).select(
        "c_custkey", "c_nationkey", "o_orderstatus"
    )


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_of_sorted_table(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC, n_name")
def sorted_table(t):
    return t.nation.select("n_name", "n_regionkey").orderBy(F.desc("n_regionkey"), "n_name")


@query("""
    SELECT c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier
""")
def stacked_by_name(t):
    customers = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    suppliers = t.supplier.select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"))
    return customers.unionByName(suppliers)


@query("""
    SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier UNION ALL SELECT p_partkey, NULL, NULL FROM part
""")
def stacked_with_gaps(t):
    return union_all([
        t.customer.select(
            F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
        ),
        None,
        t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")),
        t.part.select(F.col("p_partkey").alias("id")),
    ])


@query("""
    SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
    WHERE o_orderpriority NOT IN (SELECT o_orderpriority FROM orders WHERE o_orderpriority < '3')
    UNION ALL
    SELECT o_orderkey, o_orderpriority, o_totalprice * 2 FROM orders WHERE o_orderpriority < '3'
""")
def replaced_groups(t):
    base = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    new = base.where(F.col("o_orderpriority") < "3").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return replace_groups(base, new, ["o_orderpriority"])


@query("""
    SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS lines,
           true AS near_share, 0 AS on_two_sides, 0 AS on_no_side, 0 AS changed
""")
def rows_split_at_random(t):
    """Orders, and their lines by the same key, 0.7 to 0.3: each on one side, the same one in other partitions."""

    def sides(df, key):
        train, held_out = split_rows(df.withColumnRenamed(key, "key"), [0.7, 0.3], 43, ["key"])
        return train.select("key", F.lit(1).alias("side")).unionByName(held_out.select("key", F.lit(2).alias("side")))

    orders = sides(t.orders, "o_orderkey").withColumn("kind", F.lit("order"))
    again = sides(t.orders.repartition(5, "o_custkey"), "o_orderkey").withColumn("kind", F.lit("again"))
    lines = sides(t.lineitem.select("l_orderkey"), "l_orderkey").withColumn("kind", F.lit("line"))
    per_key = orders.unionByName(again).unionByName(lines).groupBy("key").agg(
        F.count_if(F.col("kind") == "order").alias("orders"), F.count_if(F.col("kind") == "line").alias("lines"),
        F.count_if((F.col("kind") == "order") & (F.col("side") == 1)).alias("train"),
        F.count_distinct("side").alias("n_sides"), F.count_if(F.col("kind") == "again").alias("again"),
    )
    found = per_key.agg(
        F.sum("orders").alias("orders"), F.sum("lines").alias("lines"),
        (F.abs(F.sum("train") / F.sum("orders") - 0.7) < 0.05).alias("near_share"),
        F.count_if(F.col("n_sides") > 1).alias("on_two_sides"), F.count_if(F.col("orders") != F.col("again")).alias("changed"),
    )
    return found.join(t.orders.agg(F.count("*").alias("_all")), F.lit(True)).select(
        "orders", "lines", "near_share", "on_two_sides", (F.col("_all") - F.col("orders")).alias("on_no_side"), "changed"
    )
