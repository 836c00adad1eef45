"""PageRank by repeated joins of the edges with the current ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loops import cut
from .matrix import both_directions

CUT_EVERY = 5


def pagerank(edges: DataFrame, vertices: DataFrame, damping: float = 0.85, tol: float | None = 1e-5, max_iter: int | None = None) -> DataFrame:
    """(id, pagerank) over undirected edges (u, v).

    r(v) becomes (1-d)/N + d times the sum of r(u)/deg(u) over neighbours; mass of
    vertices without edges is not dealt out again.  Stops when the ranks change by
    less than ``tol`` in all and returns the ranks before that last change, or
    returns the ranks after ``max_iter`` changes.  Pushing along edges and pulling
    over them are the same join here.
    """
    half = both_directions(edges)
    degree = half.groupBy("src").agg((1 / F.count("*")).alias("share"))
    table = half.join(degree, "src").repartition("src").persist()
    vs = vertices.select("id").persist()
    n = vs.count()
    ranks, passes = vs.withColumn("pagerank", F.lit(1.0 / max(n, 1))), 0
    while max_iter is None or passes < max_iter:
        gain = table.join(ranks, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("pagerank") * F.col("share")).alias("gain"))
        rank = F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("gain", F.lit(0.0))
        after = vs.join(gain, F.col("id") == F.col("dst"), "left").select("id", rank.alias("pagerank"))
        passes += 1
        if tol is not None:
            after = cut(after)
            change = after.join(ranks.withColumnRenamed("pagerank", "before"), "id").agg(F.sum(F.abs(F.col("pagerank") - F.col("before"))).alias("e")).first()["e"]
            if (change or 0.0) < tol:
                break
        elif passes % CUT_EVERY == 0 or passes == max_iter:
            after = cut(after)
        ranks = after
    table.unpersist()
    vs.unpersist()
    return ranks


def self_check(ranks: DataFrame) -> DataFrame:
    """One row: the sum of all ranks, and whether it is within 0.001 of 1."""
    return ranks.agg(F.sum("pagerank").alias("total")).select("total", (F.abs(F.col("total") - 1) < 1e-3).alias("correct"))
