"""A streaming histogram of events by time window: an addition to the batch kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_histogram(events: DataFrame, window: str = "1 day", lateness: str = "1 hour", time_col: str = "ts", key_col: str = "event_type") -> DataFrame:
    """(start, key, count); works on batch and streaming tables, late rows beyond ``lateness`` go in streams."""
    timed = events
    if events.isStreaming:  # event times must carry a zone; times without one are read in the session's
        timed = events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, lateness)
    counts = timed.groupBy(F.window(time_col, window).alias("w"), F.col(key_col).alias("key")).agg(F.count("*").alias("count"))
    return counts.select(F.col("w.start").alias("start"), "key", "count")
