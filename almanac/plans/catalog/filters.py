"""Filters and missing values."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.functions.missing import clear_missing
from almanac.operators.keys import numeric_rows, rule_filter
from almanac.plans.catalog.registry import query


def customers_with_orders(t):
    """Every customer next to all its orders; of those up to 200,000 nothing is known, and customers without one keep nulls."""
    known = F.col("o_totalprice") > 200000
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "c_nationkey", "c_acctbal", *[F.when(known, F.col(c)).alias(c) for c in ("o_orderkey", "o_totalprice", "o_orderstatus")]
    )


SQL_CUSTOMERS_WITH_ORDERS = """
    SELECT c_custkey, c_nationkey, c_acctbal, CASE WHEN o_totalprice > 200000 THEN o_orderkey END AS o_orderkey,
           CASE WHEN o_totalprice > 200000 THEN o_totalprice END AS o_totalprice, CASE WHEN o_totalprice > 200000 THEN o_orderstatus END AS o_orderstatus
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey
"""


@query(f"""
    SELECT c_custkey, coalesce(o_totalprice, 0) AS o_totalprice,
           CASE WHEN o_totalprice IS NULL OR c_acctbal < 0 THEN 0 ELSE sqrt(c_acctbal) END AS root
    FROM ({SQL_CUSTOMERS_WITH_ORDERS})
""")
def missing_cleared(t):
    # The square root of a negative balance is NaN, which counts as missing too.
    rows = customers_with_orders(t).select(
        "c_custkey", "o_totalprice", F.when(F.col("o_totalprice").isNotNull(), F.sqrt("c_acctbal")).alias("root")
    )
    return clear_missing(rows, ["o_totalprice", "root"])


@query(f"""
    SELECT c_custkey, o_orderkey, o_totalprice FROM ({SQL_CUSTOMERS_WITH_ORDERS})
    WHERE o_orderkey IS NOT NULL AND o_totalprice IS NOT NULL
""")
def rows_without_missing(t):
    return customers_with_orders(t).select("c_custkey", "o_orderkey", "o_totalprice").dropna()


@query("""
    SELECT o_orderkey, o_custkey FROM orders
    WHERE (o_totalprice >= 100000 AND o_totalprice < 200000 AND year(o_orderdate) = 1996) OR o_orderstatus = 'P'
""")
def comparison_filters(t):
    price = F.col("o_totalprice")
    in_year = (F.col("o_orderdate") >= "1996-01-01") & (F.col("o_orderdate") < "1997-01-01")
    return t.orders.where(
        ((price >= 100000) & (price < 200000) & in_year) | (F.col("o_orderstatus") == "P")
    ).select("o_orderkey", "o_custkey")


@query(f"SELECT c_custkey FROM ({SQL_CUSTOMERS_WITH_ORDERS}) WHERE o_orderkey IS NULL")
def null_tests(t):
    return customers_with_orders(t).where(F.col("o_orderkey").isNull()).select("c_custkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'HOUSEHOLD')")
def not_in_list(t):
    return t.customer.where(~F.col("c_mktsegment").isin("MACHINERY", "HOUSEHOLD")).select(
        "c_custkey", "c_mktsegment"
    )


@query("""
    SELECT o_orderkey, replace(o_orderpriority, '-LOW', '') AS text FROM orders
    WHERE try_cast(replace(o_orderpriority, '-LOW', '') AS DOUBLE) > 4
""")
def numeric_text_rows(t):
    text = t.orders.select("o_orderkey", F.regexp_replace("o_orderpriority", "-LOW", "").alias("text"))
    return numeric_rows(text, "text", 4)


@query("""
    SELECT o_orderkey FROM orders
    WHERE CASE WHEN year(o_orderdate) <= 1997 THEN o_totalprice > 250000 ELSE o_orderstatus = 'F' END
""")
def filter_by_rule(t):
    return rule_filter(
        t.orders, F.year("o_orderdate") <= 1997, F.col("o_totalprice") > 250000, F.col("o_orderstatus") == "F"
    ).select("o_orderkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name <> 'NATION_3' AND n_name <> 'NATION_7'")
def named_ids_dropped(t):
    return t.nation.where((F.col("n_name") != "NATION_3") & (F.col("n_name") != "NATION_7")).select(
        "n_nationkey", "n_name"
    )
