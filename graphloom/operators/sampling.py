"""Sampling rows or columns of a matrix with probability in proportion to their entries, with replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..plans.loops import cut
from .matrix import running_before, transpose


def cumulative(counts: DataFrame, key: str, weight: str) -> DataFrame:
    """(key, lo, hi): each key's share of [0, 1), in order of key."""
    total = counts.agg(F.sum(weight).alias("__total"))
    run = running_before(counts, key, weight).join(F.broadcast(total))  # one row
    return run.select(key, (F.col("offset") / F.col("__total")).alias("lo"), ((F.col("offset") + F.col(weight)) / F.col("__total")).alias("hi"))


def cdf_lookup(draws: DataFrame, shares: DataFrame, key: str, r: str = "r") -> DataFrame:
    """Draws (.., r) with the key whose share lo < r <= hi holds them (r = 0 goes to the first).

    [0, 1) is cut into buckets, one for every 16 shares (64 at least); a share is entered
    in all it touches, so a draw meets about as many shares wherever it falls.
    """
    buckets = max(64, shares.count() // 16)
    spread = shares.select(key, "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * buckets), F.least(F.floor(F.col("hi") * buckets), F.lit(buckets - 1).cast("long")))).alias("__bucket"))
    at = draws.withColumn("__bucket", F.least(F.floor(F.col(r) * buckets), F.lit(buckets - 1).cast("long")))
    inside = ((F.col(r) > F.col("lo")) & (F.col(r) <= F.col("hi"))) | ((F.col(r) == 0) & (F.col("lo") == 0))
    return at.join(spread, "__bucket").where(inside).drop("__bucket", "lo", "hi")


def sample_rows(a: DataFrame, c: int, seed: int = 12345) -> DataFrame:
    """``c`` rows drawn with replacement by their entry counts, renumbered 0 .. c-1 in order of row: (row, col)."""
    counts = a.groupBy("row").agg(F.count("*").alias("n"))
    draws = a.sparkSession.range(c).select(F.col("id").alias("draw"), uniform("id", seed=seed).alias("r"))
    picked = cut(cdf_lookup(draws, cumulative(counts, "row", "n"), "row").select("draw", "row"))
    place = running_before(picked.select(F.struct("row", "draw").alias("at"), F.lit(1).alias("one")), "at", "one")
    return place.select("at.row", F.col("offset").alias("__new")).join(a, "row").select(F.col("__new").alias("row"), "col")


def sample_columns(a: DataFrame, c: int, seed: int = 12345) -> DataFrame:
    return transpose(sample_rows(transpose(a), c, seed))


def uniform_sample(a: DataFrame, fraction: float, seed: int = 12345) -> DataFrame:
    """Each entry with the same probability, by a hash of its place."""
    return a.where(uniform("row", "col", seed=seed) < fraction)


def approximate_triangles(edges: DataFrame, p: float, seed: int = 12345) -> DataFrame:
    """One row (triangles): the count on edges kept with probability p, over p cubed (an extension)."""
    from .triangles import count_triangles

    kept = edges.where(uniform("u", "v", seed=seed) < p)
    return count_triangles(kept).select((F.col("triangles") / (p**3)).alias("triangles"))
