"""Random graph generators: every row is a function of its number and the seed.

Generators are ranges with hash expressions, so a table of 2**40 edges is as
parallel as one of 2**10, and a row never depends on how the range is cut.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rng import uniform, uniform_int
from ..schema import GeneratedGraph
from .matrix import symmetrize, transpose

#: Quadrant probabilities of the recursive generators (fixed values).
QUADRANTS = (0.57, 0.19, 0.19)


def probability(n: int, nz_per_row: float) -> float:
    """Edge probability that gives ``nz_per_row`` nonzeros in the mean row of a symmetric matrix with a diagonal."""
    return min(1.0, 2.0 * (nz_per_row - 1) / n)


def uniform_edges(spark: SparkSession, scale: int, edgefactor: int = 16, seed: int = 20011) -> GeneratedGraph:
    """Edges with both ends uniform, as u <= v; loops and repeats may occur."""
    n = 1 << scale
    a, b = uniform_int(n, "id", F.lit(0), seed=seed), uniform_int(n, "id", F.lit(1), seed=seed)
    ends = spark.range(edgefactor * n).select(a.alias("a"), b.alias("b"))
    return GeneratedGraph(ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")), scale, edgefactor)


def _quadrants(scale: int, seed: int, flip: bool) -> Column:
    """struct(u, v): one draw a bit picks the quadrant, from the highest bit on.

    ``flip``: while both ends are equal so far, a draw for the quadrant below the
    diagonal counts for the one above it.
    """
    a, b, c = QUADRANTS
    draws = F.transform(F.sequence(F.lit(0), F.lit(scale - 1)), lambda bit: uniform("id", bit, seed=seed))

    def step(acc: Column, x: Column) -> Column:
        down, right = x >= a + b, ((x >= a) & (x < a + b)) | (x > a + b + c)
        if flip:
            swap = down & ~right & (acc["u"] == acc["v"])
            down, right = down & ~swap, right | swap
        return F.struct((acc["u"] * 2 + down.cast("long")).alias("u"), (acc["v"] * 2 + right.cast("long")).alias("v"))

    start = F.struct(F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v"))
    return F.aggregate(draws, start, step)


def rmat_edges(spark: SparkSession, scale: int, edgefactor: int = 16, seed: int = 12345) -> GeneratedGraph:
    edges = spark.range(edgefactor << scale).select(_quadrants(scale, seed, flip=False).alias("e")).select("e.u", "e.v")
    return GeneratedGraph(edges, scale, edgefactor)


def scramble(v: Column, scale: int, seed: int) -> Column:
    """A bijection of [0, 2**scale): four Feistel-like rounds of hash and exchange on the two halves of the bits."""
    low = scale // 2
    high = scale - low
    lo, hi = v.bitwiseAND(F.lit((1 << low) - 1)), F.shiftright(v, low)
    for r in range(4):
        if r % 2 == 0 and high:
            hi = hi.bitwiseXOR(F.xxhash64(lo, F.lit(seed + r)).bitwiseAND(F.lit((1 << high) - 1)))
        elif low:
            lo = lo.bitwiseXOR(F.xxhash64(hi, F.lit(seed + r)).bitwiseAND(F.lit((1 << low) - 1)))
    return F.shiftleft(hi, low).bitwiseOR(lo)


def kronecker_edges(spark: SparkSession, scale: int, edgefactor: int = 16, seed: int = 12345) -> GeneratedGraph:
    """The benchmark's generator: quadrants with the diagonal flip, then scrambled vertex ids."""
    raw = spark.range(edgefactor << scale).select(_quadrants(scale, seed, flip=True).alias("e"))
    edges = raw.select(scramble(F.col("e.u"), scale, seed).alias("u"), scramble(F.col("e.v"), scale, seed).alias("v"))
    return GeneratedGraph(edges, scale, edgefactor)


def with_weights(edges: DataFrame, seed: int = 7, largest: int | None = None) -> DataFrame:
    """Add a weight in [0, 1), or a whole one in 1 .. ``largest``, that is the same for both directions of a pair."""
    ends = F.greatest("u", "v"), F.least("u", "v")
    return edges.withColumn("w", uniform(*ends, seed=seed) if largest is None else uniform_int(largest, *ends, seed=seed) + 1)


def shuffle_edges(edges: DataFrame, seed: int = 3) -> DataFrame:
    """(pos, u, v): the edge multiset in random order, pos from 0 without gaps.

    Keys are hashes of an edge and its number among its repeats, so the order does not
    depend on partitions.
    """
    from .matrix import running_before

    nth = F.row_number().over(Window.partitionBy("u", "v").orderBy("u")).cast("long")
    keys = edges.select("u", "v", nth.alias("nth")).select(F.struct(F.xxhash64("u", "v", "nth", F.lit(seed)).alias("k"), "u", "v", "nth").alias("key"), F.lit(1).alias("one"))
    return running_before(keys, "key", "one").select(F.col("offset").alias("pos"), "key.u", "key.v")


def erdos_renyi_lower(spark: SparkSession, n: int, p: float, seed: int = 12345) -> DataFrame:
    """(row, col), col < row, each pair with probability p: geometric gaps, so work is in proportion to the entries."""
    # short and long rows take turns, so that every partition draws about as many entries
    rows = spark.range(1, n).select(F.when(F.col("id") % 2 == 1, F.expr("(id + 1) div 2")).otherwise(n - F.expr("id div 2")).alias("id"))
    if p <= 0:
        return rows.select(F.col("id").alias("row"), F.col("id").alias("col")).where(F.lit(False))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            row, col = [], []
            for i in batch["id"]:
                rng, at = np.random.default_rng((seed, int(i))), -1
                while at < i:
                    need = max(16, int(1.2 * p * (i - at)) + 16)
                    at_all = at + np.cumsum(rng.geometric(p, need))
                    keep = at_all[at_all < i]
                    row.append(np.full(len(keep), i))
                    col.append(keep)
                    at = int(at_all[-1])
            yield pd.DataFrame({"row": np.concatenate(row or [[]]).astype(np.int64), "col": np.concatenate(col or [[]]).astype(np.int64)})

    return rows.mapInPandas(draw, "row long, col long")


def erdos_renyi(spark: SparkSession, n: int, p: float, mode: str = "lower", seed: int = 12345, unit_diagonal: bool = False) -> DataFrame:
    """Mode ``symmetric``, ``lower``, ``upper`` or ``asymmetric`` (two independent triangles)."""
    lower = erdos_renyi_lower(spark, n, p, seed)
    out = {"lower": lambda: lower, "upper": lambda: transpose(lower), "symmetric": lambda: symmetrize(lower), "asymmetric": lambda: lower.union(transpose(erdos_renyi_lower(spark, n, p, seed + 1)))}[mode]()
    if unit_diagonal:
        out = out.union(spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col")))
    return out


def erdos_renyi_naive(spark: SparkSession, n: int, p: float, seed: int = 12345) -> DataFrame:
    """One coin for each pair below the diagonal; for cross-checks on small n only."""
    pairs = spark.range(1, n).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") - 1)).alias("col"))
    return pairs.where(uniform("row", "col", seed=seed) < p)


def kmer_matrix(spark: SparkSession, m: int, n: int, p: float, seed: int = 12345) -> DataFrame:
    """Random m x n incidence (row, col) with at least one entry in every row and column."""
    rng_cols = spark.range(m).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("col"))
    coins = rng_cols.where(uniform("row", "col", seed=seed) < p)
    each_row = spark.range(m).select(F.col("id").alias("row"), uniform_int(n, "id", seed=seed + 1).alias("col"))
    each_col = spark.range(n).select(uniform_int(m, "id", seed=seed + 2).alias("row"), F.col("id").alias("col"))
    return coins.union(each_row).union(each_col).distinct()


def random_permutation(spark: SparkSession, n: int, seed: int = 12345) -> DataFrame:
    """(i, p): ranks of random keys; range totals keep the ranking distributed."""
    from .matrix import running_before

    keys = spark.range(n).select(F.col("id").alias("i"), F.struct(F.xxhash64("id", F.lit(seed)).alias("k"), F.col("id")).alias("key"), F.lit(1).alias("one"))
    return running_before(keys, "key", "one").select("i", F.col("offset").alias("p"))


def search_roots(edges: DataFrame, n: int, k: int = 64, seed: int = 2) -> DataFrame:
    """k distinct vertices of degree over 0 (loops do not count), picked by a hash of (seed, id)."""
    ends = edges.where("u <> v").select(F.explode(F.array("u", "v")).alias("id")).distinct()
    return ends.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k)


#: Generators by name; ``register`` adds more.
GENERATORS: dict[str, Callable[..., GeneratedGraph]] = {"uniform": uniform_edges, "rmat": rmat_edges, "kronecker": kronecker_edges}


def register(name: str, generator: Callable[..., GeneratedGraph]) -> None:
    GENERATORS[name] = generator


def generate(spark: SparkSession, kind: str, scale: int, edgefactor: int = 16, **options) -> GeneratedGraph:
    return GENERATORS[kind](spark, scale, edgefactor, **options)


def expected_edges(n: int, p: float) -> tuple[float, float]:
    """Mean and standard deviation of the entries below the diagonal."""
    pairs = n * (n - 1) / 2
    return pairs * p, math.sqrt(pairs * p * (1 - p))
