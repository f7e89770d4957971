"""Streaming forms of batch operators. The batch library has none of its own semantics here: a stream is
an unbounded table, late rows are dropped behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hour_statistics_stream(events: DataFrame, key: str, time: str, value: str, lateness: str = "2 hours") -> DataFrame:
    """AGG-02 on a stream: statistics by key and hour, final once the watermark has passed the hour."""
    out = events.withWatermark(time, lateness).groupBy(F.window(time, "1 hour"), key)
    return out.agg(F.avg(value).alias("hour_avg"), F.count(value).alias("hour_count"), F.max(value).alias("hour_max"), F.min(value).alias("hour_min")).select(key, F.col("window.start").alias("hour_start"), "hour_avg", "hour_count", "hour_max", "hour_min")
