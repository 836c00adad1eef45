"""Statistics whose rules differ from Spark's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seven_numbers(df: DataFrame, col: str) -> DataFrame:
    """One row: mean, sample stddev, min, quartiles by averaged order statistics, max; nulls are left out.

    With n sorted values from 0, the first quartile averages those at (n-1) div 4
    and n div 4, the median those at (n-1) div 2 and n div 2, and the third mirrors
    the first.  Order statistics come from value counts, so no task holds the column.
    """
    from ..operators.matrix import running_before

    x = df.where(F.col(col).isNotNull())
    counts = running_before(x.groupBy(F.col(col).alias("x")).agg(F.count("*").alias("k")), "x", "k")
    total = x.agg(F.count("*").alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("stddev"), F.min(col).alias("min"), F.max(col).alias("max"))
    spots = {"a": "(n - 1) div 4", "b": "n div 4", "c": "(n - 1) div 2", "d": "n div 2", "e": "n - 1 - (n - 1) div 4", "f": "n - 1 - n div 4"}
    joined = counts.join(F.broadcast(total))  # one row
    at = {s: F.max(F.when((F.col("offset") <= F.expr(e)) & (F.expr(e) < F.col("offset") + F.col("k")), F.col("x"))).alias(s) for s, e in spots.items()}
    found = joined.groupBy("n", "mean", "stddev", "min", "max").agg(*at.values())
    half = lambda p, q: ((F.col(p) + F.col(q)) / 2)
    return found.select("n", "mean", "stddev", "min", half("a", "b").alias("firstquartile"), half("c", "d").alias("median"), half("e", "f").alias("thirdquartile"), "max")


def harmonic_teps(runs: DataFrame, seconds: str = "seconds", edges: str = "edges") -> DataFrame:
    """One row: harmonic mean of edges per second and its standard deviation, from seconds per edge."""
    t = runs.select((F.col(seconds) / F.col(edges)).alias("t"))
    s = t.agg(F.count("*").alias("n"), F.avg("t").alias("m"), F.stddev_samp("t").alias("sd"))
    return s.select((1 / F.col("m")).alias("harmonic_mean"), (F.col("sd") / (F.col("m") * F.col("m") * F.sqrt(F.col("n") - 1))).alias("harmonic_stddev"))
