"""Jaccard similarity: of the ends of edges, and of the columns of an incidence matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .build import degrees
from .triangles import triangles


def jaccard_edges(edges: DataFrame) -> DataFrame:
    """(v, u, common, jaccard) for each simple edge, v > u; edges without common neighbours have 0.

    A common neighbour of an edge's ends is a triangle over it, so triangles are
    listed once and counted by edge: no neighbour sets are collected.
    """
    sides = F.explode(F.array(*[F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")) for x, y in ("ab", "ac", "bc")])).alias("s")
    common = triangles(edges).select(sides).select("s.u", "s.v").groupBy("u", "v").agg(F.count("*").alias("common"))
    d = degrees(edges)
    e = edges.join(common, ["u", "v"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    e = e.join(d.select(F.col("id").alias("u"), F.col("degree").alias("du")), "u").join(d.select(F.col("id").alias("v"), F.col("degree").alias("dv")), "v")
    index = F.coalesce(F.try_divide("common", F.col("du") + F.col("dv") - F.col("common")), F.lit(0.0))
    return e.select("v", "u", "common", index.alias("jaccard"))


def jaccard_columns(incidence: DataFrame, n: int | None = None) -> DataFrame:
    """(i, j, common, jaccard) for column pairs i > j of (row, col) that share a row; all pairs below ``n`` if given."""
    x = incidence.select("row", "col").distinct()
    size = x.groupBy("col").agg(F.count("*").alias("size"))
    meet = x.select("row", F.col("col").alias("i")).join(x.select("row", F.col("col").alias("j")), "row").where("i > j")
    common = meet.groupBy("i", "j").agg(F.count("*").alias("common"))
    if n is not None:
        pairs = incidence.sparkSession.range(1, n).select(F.col("id").alias("i"), F.explode(F.expr("sequence(0L, id - 1)")).alias("j"))
        common = pairs.join(common, ["i", "j"], "left")
    sized = common.join(size.select(F.col("col").alias("i"), F.col("size").alias("si")), "i", "left").join(size.select(F.col("col").alias("j"), F.col("size").alias("sj")), "j", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    index = F.coalesce(F.try_divide(z("common"), z("si") + z("sj") - z("common")), F.lit(0.0))
    return sized.select("i", "j", z("common").alias("common"), index.alias("jaccard"))
