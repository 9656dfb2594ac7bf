"""Readers: the driver's tables, and events in the shape of the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: Column | str) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log: device user_id % 4, number event_id, item user_id, grade 1 for errors and else 2 to 4 by event_id, flag for sign-ups."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("dev"), (F.col("user_id") % 4).cast("string")).alias("d"),
        F.col("event_id").alias("n"),
        F.concat(F.lit("item"), F.col("user_id").cast("string")).alias("i"),
        epoch("ts").alias("t"),
        F.when(F.col("event_type") == "error", 1).otherwise((F.col("event_id") % 3 + 2).cast("int")).alias("g"),
        F.coalesce("value", F.lit(0.0)).alias("r"),
        F.when(F.col("event_type") == "signup", "flag").otherwise("text").alias("m"),
        F.when(F.col("event_id") % 5 == 0, F.concat(F.col("event_type"), (F.col("event_id") % 7).cast("string"))).alias("a"),
    )


#: The same as event_log, in DuckDB's SQL.
EVENT_LOG_SQL = """ev AS (SELECT 'dev' || CAST(user_id % 4 AS VARCHAR) AS d, event_id AS n, 'item' || CAST(user_id AS VARCHAR) AS i, CAST(floor(epoch(ts)) AS BIGINT) AS t,
 CASE WHEN event_type = 'error' THEN 1 ELSE CAST(event_id % 3 + 2 AS INTEGER) END AS g, coalesce(value, 0.0) AS r, CASE WHEN event_type = 'signup' THEN 'flag' ELSE 'text' END AS m,
 CASE WHEN event_id % 5 = 0 THEN event_type || CAST(event_id % 7 AS VARCHAR) END AS a FROM events)"""


def item_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the log and what they cover, a row for each: the parts of the orders of the customer with the item's number."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    concept = F.concat(F.lit("w:"), F.col("l_partkey").cast("string"))
    return rows.select(F.concat(F.lit("item"), F.col("o_custkey").cast("string")).alias("i"), concept.alias("concept")).distinct().select("i", F.array("concept").alias("covers"))


ITEM_BRIDGE_SQL = "bridge AS (SELECT DISTINCT 'item' || CAST(o_custkey AS VARCHAR) AS i, 'w:' || CAST(l_partkey AS VARCHAR) AS concept FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
