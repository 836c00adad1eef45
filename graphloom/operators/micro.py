"""Histogram and index gather: a keyed count and an equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(index: DataFrame, size: int | None = None, col: str = "idx") -> DataFrame:
    """(idx, count); with ``size`` every bin 0 .. size-1 appears. Counts are summed per task before the shuffle."""
    counts = index.groupBy(F.col(col).alias("idx")).agg(F.count("*").alias("count"))
    if size is None:
        return counts
    bins = index.sparkSession.range(size).select(F.col("id").alias("idx"))
    return bins.join(counts, "idx", "left").select("idx", F.coalesce("count", F.lit(0)).alias("count"))


def index_gather(requests: DataFrame, table: DataFrame) -> DataFrame:
    """(i, val): the table's (idx, val) value for each request (i, idx); a request whose index the table lacks gets null."""
    return requests.join(table, "idx", "left").select("i", "val")


def histogram_check(index: DataFrame, counts: DataFrame) -> DataFrame:
    """Bins whose counts do not cancel the index again; none if right."""
    back = index.select("idx", F.lit(-1).alias("d")).union(counts.select("idx", F.col("count").alias("d")))
    return back.groupBy("idx").agg(F.sum("d").alias("left")).where("left <> 0")


def latency_profile(lat: DataFrame, col: str = "latency") -> DataFrame:
    return lat.agg(F.min(col).alias("min"), F.max(col).alias("max"), F.avg(col).alias("mean"))
