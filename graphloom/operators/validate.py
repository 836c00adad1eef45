"""Validation of traversal results: each check is a query that finds no row if the result is right."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validate(edges: DataFrame, result: DataFrame, root: int, weighted: bool = False, claimed_edges: int | None = None, tolerance: float = 1e-9) -> DataFrame:
    """(check, violations) for a traversal result (id, parent, depth or dist) of undirected edges (u, v[, w])."""
    d = "dist" if weighted else "depth"
    w = F.col("w") if weighted else F.lit(1)
    r = result.select("id", "parent", F.col(d).alias("d"))
    e = edges.where("u <> v").select("u", "v", w.alias("w"))
    ru, rv = (r.select(F.col("id").alias(x), F.col("parent").alias(f"p{x}"), F.col("d").alias(f"d{x}")) for x in "uv")
    near = e.join(ru, "u").join(rv, "v")
    seen_u, seen_v = F.col("pu") >= 0, F.col("pv") >= 0
    half = e.select(F.col("u").alias("parent"), F.col("v").alias("id"), "w").union(e.select("v", "u", "w"))
    child = r.where((F.col("parent") >= 0) & (F.col("id") != root))
    up = child.join(r.select(F.col("id").alias("parent"), F.col("d").alias("dp")), "parent").join(half, ["parent", "id"])
    confirmed = up.where(F.abs(F.col("d") - F.col("dp") - F.col("w")) <= tolerance).select("id").distinct()
    at_root = r.where(F.col("id") == root)
    checks = [
        ("parent_range", r.join(r.select(F.col("id").alias("parent")), "parent", "left_anti").where("parent <> -1")),
        ("reached_both_ways", r.where((F.col("parent") == -1) != (F.col("d") < 0))),
        ("root", at_root.where((F.col("parent") != F.col("id")) | (F.col("d") != 0))),
        ("edge_leaves_component", near.where(seen_u != seen_v)),
        ("edge_spans_levels", near.where(seen_u & seen_v & (F.abs(F.col("du") - F.col("dv")) > F.col("w") + tolerance))),
        ("tree_edge", child.join(confirmed, "id", "left_anti")),
    ]
    if claimed_edges is not None:
        from .traverse import traversed_edges

        checks.append(("edge_count", traversed_edges(edges, result).where(F.col("edges") != claimed_edges)))
    return reduce(DataFrame.union, [q.agg(F.lit(name).alias("check"), F.count("*").alias("violations")) for name, q in checks])
