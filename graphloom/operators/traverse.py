"""Breadth-first search and shortest paths, one level or bucket a round.

Per round only the frontier is new; the half-edges are kept partitioned by source.
The driver sees a count a round.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loops import cut
from .matrix import both_directions


def _start(vertices: DataFrame, root: int, **columns) -> DataFrame:
    return vertices.where(F.col("id") == root).select("id", *[c.alias(n) for n, c in columns.items()])


def _finish(vertices: DataFrame, seen: DataFrame, *columns: str) -> DataFrame:
    """Every vertex; -1 where it was not reached."""
    kinds = dict(seen.dtypes)
    return vertices.select("id").join(seen, "id", "left").select("id", *[F.coalesce(F.col(c), F.lit(-1)).cast(kinds[c]).alias(c) for c in columns])


def bfs(edges: DataFrame, vertices: DataFrame, root: int, direction: str = "top_down") -> DataFrame:
    """(id, parent, depth): depth by edges from ``root``; the parent is the smallest neighbour one level up.

    The root is its own parent; unreached vertices have -1.  ``top_down`` expands the
    frontier's edges; ``bottom_up`` lets unreached vertices look for a neighbour in it.
    Edges have both directions, so a neighbour of a level lies in it, the one before or
    the next: what ``top_down`` finds is held against two levels, not against all seen.
    """
    half = both_directions(edges).distinct().repartition("src").persist()
    seen = cut(_start(vertices, root, parent=F.col("id"), depth=F.lit(0)))
    before, frontier, depth = seen.limit(0), seen, 0
    while True:
        depth += 1
        if direction == "top_down":
            reached = half.join(frontier.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
            new = reached.join(before.union(frontier).select("id"), "id", "left_anti")
        else:
            open_ = vertices.select("id").join(seen.select("id"), "id", "left_anti").select(F.col("id").alias("src"))
            found = half.join(open_, "src").join(frontier.select(F.col("id").alias("dst")), "dst", "left_semi")
            new = found.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("parent"))
        before, frontier = frontier, cut(new.select("id", "parent", F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
        if depth % 8 == 0:
            seen = cut(seen)
    out = _finish(vertices, seen, "parent", "depth")
    half.unpersist()
    return out


def sssp(edges: DataFrame, vertices: DataFrame, root: int, delta: float | None = None) -> DataFrame:
    """(id, parent, dist) over undirected edges (u, v, w), w >= 0; unreached: -1.

    Rounds relax the edges of vertices whose distance fell; with ``delta`` only of
    those in the lowest bucket of that width, which saves work that later falls again.
    """
    simple = edges.where("u <> v").select("u", "v", "w")
    half = simple.select(F.col("u").alias("src"), F.col("v").alias("dst"), "w").union(simple.select("v", "u", "w")).repartition("src").persist()
    state = cut(_start(vertices, root, parent=F.col("id"), dist=F.lit(0.0), open=F.lit(True)))
    while True:
        low = state.where("open").agg(F.min("dist").alias("d")).first()["d"]
        if low is None:
            break
        active = F.col("open") & (F.lit(True) if delta is None else F.col("dist") < (low // delta + 1) * delta)
        step = state.where(active).select(F.col("id").alias("src"), "dist").join(half, "src").select(F.col("dst").alias("id"), F.col("src").alias("parent"), (F.col("dist") + F.col("w")).alias("dist"))
        best = step.groupBy("id").agg(F.min(F.struct("dist", "parent")).alias("new"))
        both = state.withColumn("open", F.col("open") & ~active).join(best, "id", "full")
        better = F.col("new").isNotNull() & (F.col("dist").isNull() | (F.col("new.dist") < F.col("dist")))
        state = cut(both.select("id", F.when(better, F.col("new.parent")).otherwise(F.col("parent")).alias("parent"), F.when(better, F.col("new.dist")).otherwise(F.col("dist")).alias("dist"), F.when(better, True).otherwise(F.col("open")).alias("open")))
    out = _finish(vertices, state.select("id", "parent", "dist"), "parent", "dist")
    half.unpersist()
    return out


def traversed_edges(edges: DataFrame, result: DataFrame, strict: bool = False) -> DataFrame:
    """One row (edges): half-edges of reached sources that point to an id not larger (``strict``: smaller)."""
    reached = result.where("parent >= 0").select(F.col("id").alias("src"))
    down = both_directions(edges).where("dst < src" if strict else "dst <= src")
    return down.join(reached, "src", "left_semi").agg(F.count("*").alias("edges"))


def run_many(edges: DataFrame, vertices: DataFrame, roots: list[int], kernel=bfs, **options) -> DataFrame:
    """(run, root, seconds, edges) of one traversal from each root; as many rows as roots."""
    spark, rows = edges.sparkSession, []
    for i, root in enumerate(roots):
        began = time.perf_counter()
        result = cut(kernel(edges, vertices, root, **options))
        seconds = time.perf_counter() - began
        rows.append((i, root, seconds, traversed_edges(edges, result).first()["edges"]))
    return spark.createDataFrame(rows, "run int, root long, seconds double, edges long")
