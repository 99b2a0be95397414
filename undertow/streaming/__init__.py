"""Streams of events into the hourly panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events (event_type, ts, value) of a stream, summed by hour and type; an hour closes once the watermark,
    ``late`` behind the newest event, has passed it. The same code runs on a batch."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    sums = timed.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select("event_type", F.col("window.start").alias("hour"), "n", "total")
