"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators.joins import attach_stats, join_prefer_left, null_safe_join, subtract_rows
from almanac.operators.keys import match_by_name, zip_rows
from almanac.plans.catalog.filters import SQL_CUSTOMERS_WITH_ORDERS, customers_with_orders
from almanac.plans.catalog.registry import query, r, rounded


@query("""
    SELECT o_orderkey AS key, l_linenumber, o_custkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey
""")
def inner_join(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_quantity")
    return t.orders.select(F.col("o_orderkey").alias("key"), "o_custkey").join(lines, "key").select(
        "key", "l_linenumber", "o_custkey", "l_quantity"
    )


@query("""
    SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
""")
def inner_join_on_different_names(t):
    customers = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return t.orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "c_name", "n_name"
    )


@query("""
    WITH sold AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS sold FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL),
         back AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS back FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
    SELECT l_partkey, l_suppkey, sold, back FROM sold JOIN back USING (l_partkey, l_suppkey)
""")
def join_on_several_keys(t):
    keys = ["l_partkey", "l_suppkey"]

    def total(flag, name):
        return t.lineitem.where(F.col("l_returnflag") == flag).groupBy(*keys).agg(F.sum("l_quantity").alias(name))

    return total("N", "sold").join(total("R", "back"), keys)


@query("""
    SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey
""")
def left_join(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


_SQL_STATUS_TOTALS = """
    SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status,
           CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority
"""


@query(f"""
    WITH a AS ({_SQL_STATUS_TOTALS}, o_orderkey FROM orders),
         b AS ({_SQL_STATUS_TOTALS}, count_if(o_totalprice > 300000) AS n FROM orders GROUP BY 1, 2)
    SELECT a.status, a.priority, o_orderkey, n FROM a LEFT JOIN b
      ON a.status IS NOT DISTINCT FROM b.status AND a.priority IS NOT DISTINCT FROM b.priority
""")
def join_with_missing_keys(t):
    marked = t.orders.select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority"),
        "o_orderkey", "o_totalprice",
    )
    totals = marked.groupBy("status", "priority").agg(F.count_if(F.col("o_totalprice") > 300000).alias("n"))
    return null_safe_join(marked.drop("o_totalprice"), totals, ["status", "priority"], "left")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(t):
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left_anti")


@query(f"""
    SELECT c_custkey, o_orderstatus FROM ({SQL_CUSTOMERS_WITH_ORDERS}) a
    WHERE NOT EXISTS (
        SELECT 1 FROM ({SQL_CUSTOMERS_WITH_ORDERS}) b
        WHERE (b.o_orderstatus IS NULL AND b.c_acctbal < 0 OR b.o_orderstatus = 'F')
          AND a.c_custkey = b.c_custkey AND a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus)
""")
def subtracted_rows(t):
    rows = customers_with_orders(t)
    status = F.col("o_orderstatus")
    taken = rows.where((status.isNull() & (F.col("c_acctbal") < 0)) | (status == "F"))
    return subtract_rows(
        rows.select("c_custkey", "o_orderstatus"), taken.select("c_custkey", "o_orderstatus")
    )


@query("""
    SELECT p_partkey, p_name, p_size, n.qty AS qty FROM part
    LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1) n ON p_partkey = l_partkey
""")
def join_keeping_left_columns(t):
    sold = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.sum("l_quantity").alias("qty"), F.max("l_returnflag").alias("p_name")
    )
    return join_prefer_left(t.part.select("p_partkey", "p_name", "p_size"), sold, ["p_partkey"])


@query("""
    WITH u AS (SELECT conv_id, text AS question, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS at
               FROM conversations WHERE role = 'user'),
         a AS (SELECT conv_id, text AS answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS at
               FROM conversations WHERE role = 'assistant')
    SELECT u.conv_id, question, answer FROM u JOIN a ON u.conv_id = a.conv_id AND u.at = a.at
""")
def rows_paired_by_place(t):
    questions = t.conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answers = t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    return zip_rows(questions, answers, "conv_id", "turn", "turn").select("conv_id", "question", "answer")


@query("""
    SELECT o_orderkey, o_custkey, first_year, last_year FROM orders JOIN (
        SELECT o_custkey, min(year(o_orderdate))::INT AS first_year, max(year(o_orderdate))::INT AS last_year
        FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) USING (o_custkey)
""")
def bounds_of_entities(t):
    bounds = t.orders.where(F.col("o_orderstatus") == "F").groupBy("o_custkey").agg(
        F.min(F.year("o_orderdate")).alias("first_year"), F.max(F.year("o_orderdate")).alias("last_year")
    )
    return t.orders.select("o_orderkey", "o_custkey").join(bounds, "o_custkey")


@query(f"""
    SELECT l_orderkey, l_linenumber, {r("l_quantity / q", 6)} AS share, n
    FROM lineitem, (SELECT avg(l_quantity) AS q, count(*) AS n FROM lineitem)
""")
def one_row_attached(t):
    row = t.lineitem.agg(F.avg("l_quantity").alias("q"), F.count("*").alias("n"))
    out = attach_stats(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), row)
    return out.select("l_orderkey", "l_linenumber", rounded(F.col("l_quantity") / F.col("q"), 6).alias("share"), "n")


@query("""
    WITH a AS (SELECT p_name, p_size, p_brand, p_partkey FROM part),
         b AS (SELECT p_name, p_size, CASE WHEN p_type = 'ECONOMY' THEN 'x' || p_brand ELSE p_brand END AS p_brand, p_retailprice FROM part),
         shared AS (SELECT p_name, p_size FROM a GROUP BY 1, 2 HAVING count(*) > 1),
         offers AS (
             SELECT a.*, b.p_retailprice, coalesce(substr(a.p_brand, 1, 7) = substr(b.p_brand, 1, 7), false) AS agrees,
                    count(*) OVER (PARTITION BY a.p_name, a.p_size) AS n,
                    max(coalesce(substr(a.p_brand, 1, 7) = substr(b.p_brand, 1, 7), false)::INT)
                        OVER (PARTITION BY a.p_name, a.p_size) AS settled
             FROM a LEFT JOIN b ON a.p_name = b.p_name AND a.p_size = b.p_size
             WHERE NOT EXISTS (SELECT 1 FROM shared s WHERE s.p_name = a.p_name AND s.p_size = a.p_size))
    SELECT p_name, p_size, p_brand, p_partkey, p_retailprice FROM offers WHERE n = 1 OR agrees OR settled = 0
    UNION ALL
    SELECT a.*, b.p_retailprice FROM a JOIN shared s ON s.p_name = a.p_name AND s.p_size = a.p_size
    LEFT JOIN b ON a.p_name = b.p_name AND a.p_size = b.p_size AND a.p_brand = b.p_brand
""")
def matched_by_name(t):
    # The second list spells the brands of some types in another way.
    brand = F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("x"), "p_brand")).otherwise(F.col("p_brand"))
    a = t.part.select("p_name", "p_size", "p_brand", "p_partkey")
    b = t.part.select("p_name", "p_size", brand.alias("p_brand"), "p_retailprice")
    return match_by_name(a, b, ["p_name", "p_size"], "p_brand", prefix=7)
