"""Structured Streaming: deduplicated streams, span pairs within a time limit, hourly counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import whole


def timed(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``stream`` with a watermark on ``ts``, from ``ts_ns``."""
    return stream.withColumn("ts", F.timestamp_micros(whole(F.col("ts_ns"), 1000))).withWatermark("ts", late)


def deduplicated(stream: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Replayed events once each, as long as they come within the watermark."""
    return timed(stream, late).dropDuplicatesWithinWatermark(keys)


def hourly(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(hour_start_ns, full_name, n) by tumbling hour; each hour once it's closed."""
    counts = timed(stream, late).groupBy(F.window("ts", "1 hour"), "full_name").agg(F.count("*").alias("n"))
    return counts.select((F.unix_micros("window.start") * 1000).alias("hour_start_ns"), "full_name", "n")


def pairs(started: DataFrame, completed: DataFrame, key: str = "span_id", limit: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Started events with the Completed of their key within ``limit``, null for orphans.

    State older than the limit and the watermark is dropped, so it stays bounded.
    """
    s = timed(started, late).select(F.col(key).alias("started_key"), F.col("ts").alias("started"), F.col("ts_ns").alias("start_ns"))
    c = timed(completed, late).select(F.col(key).alias("completed_key"), F.col("ts").alias("completed"), F.col("ts_ns").alias("end_ns"))
    near = (F.col("started_key") == F.col("completed_key")) & (F.col("completed") >= F.col("started")) & (F.col("completed") <= F.col("started") + F.expr(f"interval {limit}"))
    return s.join(c, near, "left_outer")
