"""Structured Streaming: windowed counts, rate limits, repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(events: DataFrame) -> DataFrame:
    """Tumbling hourly counts by type, over a batch or a stream with timestamps in ``ts``."""
    return events.groupBy(F.window("ts", "1 hour").alias("_w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("_w.start").alias("hour"), "event_type", "n")


def sliding_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counts of 30 minutes every 10, late rows up to ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "30 minutes", "10 minutes").alias("w"), "event_type").count()


def minute_hits(requests: DataFrame, key: str, limit: int, late: str = "1 minute") -> DataFrame:
    """Requests of each key and minute, and how many are over the limit."""
    counted = requests.withWatermark("ts", late).groupBy(F.window("ts", "1 minute").alias("w"), key).agg(F.count(F.lit(1)).alias("hits"))
    return counted.withColumn("over", F.greatest(F.col("hits") - limit, F.lit(0)))


def once_each(events: DataFrame, key: str, within: str = "1 hour") -> DataFrame:
    """Rows of a stream, each key once within the watermark."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])
