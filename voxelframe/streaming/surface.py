"""Picks as a stream: surfaces kept up to date by structured streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_logs(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Count, sum and range of values by window and kind; works on streams
    (events later than ``late`` are left out) and on tables alike."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return g.select(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(w.start as timestamp_ntz))").alias("start"), "event_type", "n", "total", "lo", "hi")


def running_surface(points: DataFrame) -> DataFrame:
    """Trace depths of a stream of points (i, x, d): complete or update mode."""
    return points.groupBy("i", "x").agg(F.count("*").alias("n"), F.min("d").alias("d_min"), F.max("d").alias("d_max"), F.avg("d").alias("d_mean"))
