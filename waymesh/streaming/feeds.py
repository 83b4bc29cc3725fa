"""Streaming forms of two batch operators; an addition to the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(stream: DataFrame, time: str, key: str, lateness: str = "1 hour") -> DataFrame:
    """(hour, key, n): rows per hour and key; rows later than the lateness are dropped and state older than it is freed."""
    at = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", lateness)
    return at.groupBy(F.window("_at", "1 hour"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), key, "n")


def once_within(stream: DataFrame, keys: list[str], time: str, lateness: str = "1 hour") -> DataFrame:
    """Each key once within the lateness: repeated deliveries drop out with bounded state."""
    return stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", lateness).dropDuplicatesWithinWatermark(keys).drop("_at")
