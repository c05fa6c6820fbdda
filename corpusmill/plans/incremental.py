"""Incremental work over the synthetic tables, as batch queries with the semantics of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import table
from ..streaming import incremental as I
from .registry import query


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to do: inputs without an output yet."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT user_id, max(ts) AS last_ts, CASE WHEN max(ts) >= TIMESTAMP '2024-01-30' - INTERVAL 1 DAY THEN 'alive' ELSE 'dead' END AS state FROM events GROUP BY user_id")
def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    return last.withColumn("state", F.when(F.col("last_ts") >= F.expr("timestamp_ntz'2024-01-30' - interval 1 day"), "alive").otherwise("dead"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.tumbling(table(spark, sf_dir, "events"), "6 hours")


@query("""SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS start FROM events) GROUP BY 1, 2""")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.sliding(table(spark, sf_dir, "events"), "12 hours", "6 hours")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.sessions(table(spark, sf_dir, "events"), "6 hours")


@query("SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1")
def poll_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream of files until nothing is new, and its state returned."""
    return I.replay_counts(spark, sf_dir)
