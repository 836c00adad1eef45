"""Graph construction: both half-edges of every edge go to the part that owns their source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.partition import owner
from ..schema import BuiltGraph
from .matrix import both_directions


def build(edges: DataFrame, vertices: DataFrame, n: int, parts: int, scheme: str = "cyclic", drop_self_loops: bool = True) -> BuiltGraph:
    """Place vertices by ``scheme`` and half-edges with their source."""
    half = both_directions(edges, drop_self_loops).withColumn("owner", owner(scheme, "src", parts, n))
    placed = half.repartitionById(parts, F.col("owner").cast("int"))
    return BuiltGraph(placed, vertices.select("id", owner(scheme, "id", parts, n).alias("owner")), parts)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) of all ends of undirected edges (u, v)."""
    return edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def local_ids(vertices: DataFrame) -> DataFrame:
    """Add ``local_id``, a vertex's number among its owner's by id (vertices: id, owner)."""
    return vertices.withColumn("local_id", F.row_number().over(Window.partitionBy("owner").orderBy("id")).cast("long") - 1)


def global_id(local_id, owner_id, parts: int):
    """The cyclic scheme's inverse."""
    return local_id * parts + owner_id


def load_balance(half_edges: DataFrame, parts: int) -> DataFrame:
    """One row over the parts' half-edge counts: lowest, highest, total, mean, population variance, largest
    deviation from the mean, and that over the mean.  Parts without edges count as 0."""
    loads = half_edges.groupBy("owner").agg(F.count("*").alias("load"))
    every = half_edges.sparkSession.range(parts).select(F.col("id").alias("owner"))
    load = every.join(loads, "owner", "left").select(F.coalesce("load", F.lit(0)).alias("load"))
    s = load.agg(F.min("load").alias("lowest"), F.max("load").alias("highest"), F.sum("load").alias("total"), F.avg("load").alias("mean"), F.var_pop("load").alias("variance"))
    worst = F.greatest(F.col("highest") - F.col("mean"), F.col("mean") - F.col("lowest"))
    return s.withColumn("max_deviation", worst).withColumn("imbalance", F.coalesce(F.try_divide("max_deviation", "mean"), F.lit(0.0)))


def graph_stats(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: vertices, half-edges, largest degree, isolated vertices."""
    d = vertices.join(degrees(edges), "id", "left").select(F.coalesce("degree", F.lit(0)).alias("degree"))
    return d.agg(F.count("*").alias("vertices"), F.sum("degree").alias("half_edges"), F.max("degree").alias("max_degree"), F.count(F.when(F.col("degree") == 0, 1)).alias("isolated"))


def push_pull_estimate(lower: DataFrame) -> DataFrame:
    """One row: messages that the two triangle algorithms send over a lower triangle: sum of row x column counts, and of C(row count, 2)."""
    r = lower.groupBy(F.col("row").alias("id")).agg(F.count("*").alias("r"))
    c = lower.groupBy(F.col("col").alias("id")).agg(F.count("*").alias("c"))
    pulls, pushes = F.sum(F.coalesce("r", F.lit(0)) * F.coalesce("c", F.lit(0))), F.sum(F.coalesce(F.expr("r * (r - 1) div 2"), F.lit(0)))
    return r.join(c, "id", "full").agg(F.coalesce(pushes, F.lit(0)).alias("pushes"), F.coalesce(pulls, F.lit(0)).alias("pulls"))


def part_stats(half_edges: DataFrame, parts: int) -> DataFrame:
    """One row: the most and fewest half-edges of a part, their whole mean, the difference, and that in percent of the mean (0 if there are no edges)."""
    s = load_balance(half_edges, parts).select("highest", "lowest", F.expr("total div {}".format(parts)).alias("average"))
    s = s.withColumn("delta", F.col("highest") - F.col("lowest"))
    return s.withColumn("percent", F.coalesce(F.try_divide(F.col("delta") * 100.0, F.col("average")), F.lit(0.0)))
