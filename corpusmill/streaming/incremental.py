"""Incremental processing with Structured Streaming: re-scans, upserts and event-time windows.

The window functions take a batch or a streaming DataFrame; on a stream, put `watermarked` first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def watermarked(events: DataFrame, delay: str) -> DataFrame:
    """Event time as a timestamp, with rows later than `delay` left out of closed windows."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def tumbling(events: DataFrame, width: str) -> DataFrame:
    out = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    return events.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def rescan(spark: SparkSession, path: str, schema, checkpoint: str, handle: Callable[[DataFrame, int], None], fmt: str = "parquet", **options) -> None:
    """Handle the files of a directory that were not handled yet, then stop; a later call goes on from there."""
    stream = spark.readStream.format(fmt).schema(schema).options(**options).load(path)
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def unseen(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Rows whose key did not come before within the watermark: claims of several workers become one."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def upsert(old: DataFrame | None, new: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key over what was there and what is new; of equal versions, the new one."""
    rows = new.withColumn("__new", F.lit(1))
    if old is not None:
        rows = rows.unionByName(old.withColumn("__new", F.lit(0)))
    w = Window.partitionBy(key).orderBy(F.col(version).desc(), F.col("__new").desc())
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__new")


def replay_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and last ids by event type of the events table, as the state of a finished streaming query."""
    import tempfile
    import uuid

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="corpusmill-")
    place, name = f"{shared}/stream-{uuid.uuid4().hex}", f"counts_{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    counts = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))
    counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
