"""Streaming queries over the table of events, with the SQL that they equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.plans.storage import shared_dir
from leadloom.streaming import feeds


def stream_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as snapshots of orders, accumulated by a stream: last value, first and last day of each."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    events = feeds.new_files(spark, sf_dir, schema, "parquet", "events*.parquet")
    raw = events.select(
        F.lit("feed").alias("source"), F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("source_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.lit("u").alias("unit"),
        F.col("event_id").alias("pos"), F.col("event_type").alias("title"), F.col("value").cast("string").alias("budget"), F.col("user_id").cast("string").alias("buyer"),
    )
    root = shared_dir(spark, "stream-orders")
    feeds.accumulate_orders(raw, root, shared_dir(spark, "stream-checkpoint")).awaitTermination()
    return feeds.accumulated_orders(spark, root).select("id", "budget", "first_seen", "last_seen")


QUERIES = {"stream_orders": stream_orders}
ORACLES = {
    "stream_orders": """SELECT 'feed:' || event_type || '-' || user_id AS id, arg_max(CASE WHEN value > 0 THEN value ELSE -1 END, (strftime(ts, '%Y-%m-%d'), event_id)) AS b,
  CASE WHEN b > 0 THEN b END AS budget, min(strftime(ts, '%Y-%m-%d')) AS first_seen, max(strftime(ts, '%Y-%m-%d')) AS last_seen FROM events GROUP BY 1"""
}
ORACLES["stream_orders"] = "SELECT id, budget, first_seen, last_seen FROM (" + ORACLES["stream_orders"] + ")"
