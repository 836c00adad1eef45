"""Sparse 0/1 matrices as (row, col) tables: transforms, predicates, products."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# --- transforms --------------------------------------------------------------------------


def tril(a: DataFrame, k: int = 0) -> DataFrame:
    """Entries on or below the k-th diagonal."""
    return a.where(F.col("col") - F.col("row") <= k)


def triu(a: DataFrame, k: int = 0) -> DataFrame:
    """Entries on or above the k-th diagonal."""
    return a.where(F.col("col") - F.col("row") >= k)


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"))


def symmetrize(a: DataFrame) -> DataFrame:
    """A or its transpose, each entry once."""
    return a.select("row", "col").union(transpose(a)).distinct()


def drop_loops(a: DataFrame) -> DataFrame:
    return a.where("row <> col")


def permute(a: DataFrame, row_perm: DataFrame, col_perm: DataFrame) -> DataFrame:
    """Row i goes to row p(i), column j to column q(j); permutations are tables (i, p)."""
    r, c = (x.select(F.col("i").alias(f"{n}_i"), F.col("p").alias(f"{n}_p")) for n, x in (("r", row_perm), ("c", col_perm)))
    moved = a.join(r, F.col("row") == F.col("r_i")).join(c, F.col("col") == F.col("c_i"))
    return moved.select(F.col("r_p").alias("row"), F.col("c_p").alias("col"))


def adjacency(a: DataFrame) -> DataFrame:
    """(row, cols): the sorted columns of each nonempty row."""
    return a.groupBy("row").agg(F.sort_array(F.collect_list("col")).alias("cols"))


def row_slice(a: DataFrame, row: int) -> DataFrame:
    return a.where(F.col("row") == row).select("col")


def simplify_weighted(edges: DataFrame) -> DataFrame:
    """No loops, (hi, lo) once with its least weight: the canonical form of a weighted graph (u, v, w)."""
    hi, lo = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    return edges.where("u <> v").select(hi, lo, "w").groupBy("u", "v").agg(F.min("w").alias("w"))


def orient(edges: DataFrame) -> DataFrame:
    """Every pair with the larger id first; repeated pairs stay."""
    return edges.select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo"))


def both_directions(edges: DataFrame, drop_self_loops: bool = True) -> DataFrame:
    """(src, dst) half-edges of an undirected multiset (u, v)."""
    e = edges.where("u <> v") if drop_self_loops else edges
    return e.select(F.col("u").alias("src"), F.col("v").alias("dst")).union(e.select("v", "u"))


# --- compressed rows ---------------------------------------------------------------------


#: Rows of one range of a running sum.
RANGE_ROWS = 1 << 20


def running_before(rows: DataFrame, key: str, value: str, chunks: int | None = None) -> DataFrame:
    """Add ``offset``: the sum of ``value`` over all smaller keys, without sorting all rows in one task.

    Keys (unique) are cut into ranges; range totals are summed up, then each range
    adds its rows' running sum to its start.  There are as many ranges as keep each to
    about RANGE_ROWS rows, 8 at least.
    """
    chunks = chunks or max(8, -(-rows.count() // RANGE_ROWS))
    by = rows.repartitionByRange(chunks, key).withColumn("__part", F.spark_partition_id())
    from ..plans.loops import cut

    by = cut(by)  # range borders are sampled, so the cut must not be made twice
    totals = by.groupBy("__part").agg(F.sum(value).alias("__sum"))
    up_to = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__part", F.coalesce(F.sum("__sum").over(up_to), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    local = by.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(F.broadcast(starts), "__part").withColumn("offset", F.col("__start") + F.col("__in")).drop("__part", "__start", "__in")


def csr_offsets(a: DataFrame) -> DataFrame:
    """(row, degree, offset) of every nonempty row."""
    return running_before(a.groupBy("row").agg(F.count("*").alias("degree")), "row", "degree")


def csr_to_coo(offsets: DataFrame, targets: DataFrame) -> DataFrame:
    """(row, col) from (row, degree, offset) and (pos, col): an expansion of positions and an equi-join."""
    at = offsets.select("row", F.explode(F.sequence("offset", F.col("offset") + F.col("degree") - 1)).alias("pos"))
    return at.join(targets, "pos").select("row", "col")


# --- predicates --------------------------------------------------------------------------


def is_lower_triangular(a: DataFrame, numrows: int | Column | None = None) -> DataFrame:
    """One row (ok): nothing above the diagonal and, if ``numrows`` is given, a full diagonal."""
    above = F.count(F.when(F.col("col") > F.col("row"), 1))
    pivots = F.count_distinct(F.when(F.col("col") == F.col("row"), F.col("row")))
    full = F.lit(True) if numrows is None else pivots == numrows
    return a.agg(((above == 0) & full).alias("ok"))


def is_upper_triangular(a: DataFrame, numrows: int | Column | None = None) -> DataFrame:
    return is_lower_triangular(transpose(a), numrows)


def is_permutation(p: DataFrame, n: int | None = None) -> DataFrame:
    """One row (ok): the values p of (i, p) hit 0 .. n-1 once each; n is the number of rows unless given."""
    size = F.count("*") if n is None else F.lit(n)
    ok = (F.count("p") == size) & (F.count_distinct("p") == size) & (F.coalesce(F.min("p"), F.lit(0)) >= 0) & (F.coalesce(F.max("p"), F.lit(-1)) < size)
    return p.agg(ok.alias("ok"))


def matrices_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (equal): the same entries as often."""
    tagged = a.select("row", "col", F.lit(1).alias("s")).union(b.select("row", "col", F.lit(-1)))
    odd = tagged.groupBy("row", "col").agg(F.sum("s").alias("s")).where("s <> 0")
    return odd.agg((F.count("*") == 0).alias("equal"))


def isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices (id) that no edge (u, v) touches."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("id"))
    return vertices.select("id").join(ends, "id", "left_anti")


# --- stars and Kronecker products --------------------------------------------------------


def star(spark: SparkSession, m: int, mode: int = 0) -> DataFrame:
    """Hub 0 and m leaves, both directions; mode 1 adds a loop at the hub, mode 2 at the last leaf."""
    leaves = spark.range(1, m + 1)
    out = leaves.select(F.lit(0).cast("long").alias("row"), F.col("id").alias("col"))
    out = out.union(leaves.select("id", F.lit(0).cast("long")))
    if mode in (1, 2):
        at = 0 if mode == 1 else m
        out = out.union(spark.range(at, at + 1).select("id", F.col("id").alias("c")))
    return out


#: A factor of a Kronecker product that every task may hold.
KRON_ENTRIES = 1_000_000


def kron(b: DataFrame, c: DataFrame, c_rows: int, c_cols: int, lower: bool = False) -> DataFrame:
    """Kronecker product; the factor of fewer entries is counted and broadcast, and more than KRON_ENTRIES are refused."""
    small = b if (nb := b.count()) < (nc := c.count()) else c
    if min(nb, nc) > KRON_ENTRIES:
        raise ValueError(f"the smaller factor has more than {KRON_ENTRIES} entries")
    x, y = b.select(F.col("row").alias("rb"), F.col("col").alias("cb")), c.select(F.col("row").alias("rc"), F.col("col").alias("cc"))
    pairs = y.crossJoin(F.broadcast(x)) if small is b else x.crossJoin(F.broadcast(y))
    out = pairs.select((F.col("rb") * c_rows + F.col("rc")).alias("row"), (F.col("cb") * c_cols + F.col("cc")).alias("col"))
    return tril(out, -1) if lower else out


def kron_of_stars(spark: SparkSession, sizes: list[int], mode: int = 0, lower: bool = True) -> tuple[DataFrame, int]:
    """Product of stars of the given sizes, and its number of rows."""

    def step(acc: tuple[DataFrame, int], m: int) -> tuple[DataFrame, int]:
        return kron(acc[0], star(spark, m, mode), m + 1, m + 1), acc[1] * (m + 1)

    a, n = reduce(step, sizes[1:], (star(spark, sizes[0], mode), sizes[0] + 1))
    return (tril(a, -1) if lower else a), n


def kron_triangles(sizes: list[int], mode: int) -> int:
    """Closed form of the triangles in a product of stars."""
    if mode == 0:
        return 0
    if mode == 2:
        return round(4 ** len(sizes) / 6 - 2.0 ** (len(sizes) - 1) + 1 / 3)
    wedge = loops = 1
    for m in sizes:
        wedge, loops = wedge * (3 * m + 1), loops * (m + 1)
    return round(wedge / 6 - loops / 2 + 1 / 3)
