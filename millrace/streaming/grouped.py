"""Grouped statistics over a stream: the table functions' continuous counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_stats(stream: DataFrame, time: str, value: str, by: list[str], window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """count, mean, min and max by group and time window; rows later than ``late`` are left out, so state stays bounded."""
    c = F.col(value)
    timed = stream.withWatermark(time, late).groupBy(F.window(time, window), *by)
    return timed.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max")).select(F.col("window.start").alias("start"), *by, "count", "mean", "min", "max")
