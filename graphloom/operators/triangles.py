"""Triangles: listing, counts, centrality.

Edges point from the end of lower (degree, id) to the higher, which bounds a
vertex's out-degree by the square root of twice the edge count; wedges are then
joined at their lowest corner and closed by a semi-join-like equi-join.  Hubs are
thus never the centre of a wedge, and AQE splits what skew is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .build import degrees


def oriented(edges: DataFrame) -> DataFrame:
    """(a, b) for each simple edge (u, v), from the lower (degree, id) to the higher."""
    d = degrees(edges)
    du, dv = d.select(F.col("id").alias("u"), F.col("degree").alias("du")), d.select(F.col("id").alias("v"), F.col("degree").alias("dv"))
    e = edges.join(du, "u").join(dv, "v")
    forward = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    return e.select(F.when(forward, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(forward, F.col("v")).otherwise(F.col("u")).alias("b"), F.when(forward, F.col("dv")).otherwise(F.col("du")).alias("db"))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) once for each triangle of simple edges (u < v)."""
    o = oriented(edges)
    x, y = o.select("a", "b", "db"), o.select("a", F.col("b").alias("c"), F.col("db").alias("dc"))
    wedges = x.join(y, "a").where("db < dc or (db = dc and b < c)").select("a", "b", "c")
    closing = o.select(F.col("a").alias("b"), F.col("b").alias("c"))
    return wedges.join(closing, ["b", "c"]).select("a", "b", "c")


def count_triangles(edges: DataFrame, alg: int = 0) -> DataFrame:
    """One row (triangles). ``alg`` 0 closes wedges at their lowest corner, 1 paths through the middle one; same total."""
    if alg == 0:
        return triangles(edges).agg(F.count("*").alias("triangles"))
    o = oriented(edges).select("a", "b")
    # paths a -> b -> c: an edge has no more of them than its end's out-degree, which the order bounds
    paths = o.join(o.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", "c")
    return paths.join(o.select("a", F.col("b").alias("c")), ["a", "c"]).agg(F.count("*").alias("triangles"))


def vertex_triangles(found: DataFrame) -> DataFrame:
    """(id, triangles) of all vertices in some triangle."""
    return found.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))


def triangle_edges(found: DataFrame) -> DataFrame:
    """Distinct directed (v, u) that lie in some triangle."""
    pairs = F.explode(F.array(*[F.struct(F.col(x).alias("v"), F.col(y).alias("u")) for x, y in ("ab", "ba", "ac", "ca", "bc", "cb")])).alias("p")
    return found.select(pairs).select("p.v", "p.u").distinct()


def triangle_centrality(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, centrality) of every vertex.

    (T(v)/3 + the sum of T(u)/3 over neighbours in a triangle with v + the sum of
    T(u) over the others) / all triangles; 0 everywhere if there is no triangle.
    """
    from ..plans.loops import cut

    found = cut(triangles(edges))
    t, flag = cut(vertex_triangles(found)), triangle_edges(found).withColumn("near", F.lit(True))
    total = t.agg((F.coalesce(F.sum("triangles"), F.lit(0)) / 3).alias("total"))
    # only neighbours with a triangle add anything
    half = edges.select(F.col("u").alias("v"), F.col("v").alias("u")).union(edges.select("v", "u").select(F.col("v"), F.col("u")))
    gain = half.join(t.select(F.col("id").alias("u"), F.col("triangles").alias("tu")), "u").join(flag, ["v", "u"], "left")
    around = gain.groupBy(F.col("v").alias("id")).agg(F.sum(F.when(F.col("near"), F.col("tu"))).alias("near"), F.sum(F.when(F.col("near").isNull(), F.col("tu"))).alias("far"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    parts = vertices.select("id").join(t, "id", "left").join(around, "id", "left").join(F.broadcast(total))  # one row
    value = (z("triangles") / 3 + z("near") / 3 + z("far")) / F.col("total")
    return parts.select("id", F.when(F.col("total") > 0, value).otherwise(0.0).alias("centrality"))
