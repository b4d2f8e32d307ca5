"""Files written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators.settle import scratch_path
from almanac.plans.catalog.registry import query
from almanac.sources.files import (
    read_checked_csv, read_json_records, read_snapshot, read_stats_csv, replace_partitions, write_stats_csv,
)
from almanac.sources.pages import clean_names


@query("""
    SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS o_orderpriority,
           CASE WHEN o_totalprice < 250000 THEN o_totalprice END AS o_totalprice
    FROM orders
""")
def csv_round_trip(t):
    orders = t.orders.select(
        "o_orderkey", "o_custkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(F.col("o_totalprice") < 250000, F.col("o_totalprice")).alias("o_totalprice"),
    )
    path = scratch_path(orders.sparkSession)
    write_stats_csv(orders, path)
    return read_stats_csv(orders.sparkSession, path, orders.schema)


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 NOT IN (0, 3) THEN o_totalprice END AS o_totalprice,
           CASE o_orderkey % 7 WHEN 0 THEN o_orderkey || ',x' || round(o_totalprice)::BIGINT WHEN 3 THEN o_orderkey::VARCHAR END AS line
    FROM orders
""")
def csv_with_rejected_lines(t):
    """Orders as lines, some of them with a price that is no number or without one: rows and rejects, side by side."""
    key, price = F.col("o_orderkey").cast("string"), F.col("o_totalprice")
    line = F.when(key % 7 == 0, F.concat(key, F.lit(",x"), F.round(price).cast("long").cast("string")))
    line = line.when(key % 7 == 3, key).otherwise(F.concat(key, F.lit(","), price.cast("string")))
    path = scratch_path(t.orders.sparkSession)
    t.orders.select(line.alias("value")).write.text(path)
    good, bad = read_checked_csv(t.orders.sparkSession, path, "o_orderkey long, o_totalprice double", header=False)
    rejected = bad.select(F.substring_index("line", ",", 1).cast("long").alias("o_orderkey"), "line")
    return good.unionByName(rejected, allowMissingColumns=True)


@query("SELECT event_id, user_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def json_records(t):
    spark = t.events.sparkSession
    path = scratch_path(spark)
    t.events.select("event_id", "user_id", F.from_json("props", "k long").alias("props"), "event_type").write.json(path)
    records = read_json_records(spark, path, "event_id long, user_id long, props struct<k: long>")
    return records.select("event_id", "user_id", F.col("props.k").alias("k"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def snapshot_load(t):
    path = scratch_path(t.customer.sparkSession)
    t.customer.write.parquet(path)
    return read_snapshot(t.customer.sparkSession, path, "c_custkey long, c_name string, c_acctbal double")


@query("SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders")
def replaced_partitions(t):
    orders = t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority")
    path = scratch_path(orders.sparkSession)
    replace_partitions(orders, path, "o_orderpriority")
    low = orders.where(F.col("o_orderpriority") == "5-LOW").withColumn("o_totalprice", F.lit(0.0))
    replace_partitions(low, path, "o_orderpriority")
    return read_snapshot(
        orders.sparkSession, path, "o_orderkey long, o_totalprice double, o_orderpriority string"
    )


@query("""
    SELECT r_regionkey AS region_key, r_name AS region_name, n_name AS region_name_2, n_nationkey AS nation_key
    FROM region JOIN nation ON r_regionkey = n_regionkey
""")
def cleaned_names(t):
    joined = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey"))
    return clean_names(
        joined.select("r_regionkey", "r_name", "n_name", "n_nationkey").toDF(
            "Region Key", "Region.Name", " region-name", "Nation  Key "
        )
    )
