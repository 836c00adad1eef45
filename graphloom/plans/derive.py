"""Graphs that the checker's tables hold, each with the same definition in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_graph(spark: SparkSession, sf_dir: str, returned_only: bool = True) -> DataFrame:
    """(u, v), u < v: parts that stand in one order (``returned_only``: both on returned lines)."""
    lines = table(spark, sf_dir, "lineitem")
    lines = lines.where("l_returnflag = 'R'") if returned_only else lines
    a = lines.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("u")).distinct()
    return a.join(a.withColumnRenamed("u", "v"), "o").where("u < v").select("u", "v").distinct()


def part_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id) of all parts, with or without edges."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v, w) multiset: consecutive lines of an order, loops and repeats included; w from the line's number and ids."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    b = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("v"))
    pairs = lines.withColumnRenamed("l_partkey", "u").join(b, ["l_orderkey", "l_linenumber"])
    return pairs.select("u", "v", ((F.col("u") + F.col("v") + F.col("l_linenumber")) % 97 + 1).cast("long").alias("w"))


def weighted(edges: DataFrame) -> DataFrame:
    """Weights in hundredths from the ids of an edge."""
    return edges.withColumn("w", (1 + (F.col("u") * 31 + F.col("v") * 17) % 100) / 100.0)


def incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col): which suppliers (columns) stand in which orders (rows)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_suppkey").alias("col")).distinct()


def square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col) of part and supplier numbers seen together: entries on both sides of the diagonal and on it."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col")).distinct()


PART_E = """
r AS MATERIALIZED (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R'),
e AS MATERIALIZED (SELECT DISTINCT a.p AS u, b.p AS v FROM r a JOIN r b ON a.o = b.o AND a.p < b.p)"""
HALF_E = PART_E + """,
h AS MATERIALIZED (SELECT u AS src, v AS dst FROM e UNION ALL SELECT v, u FROM e)"""
VERTICES = """vs AS MATERIALIZED (SELECT p_partkey AS id FROM part)"""
DEGREES = """d AS MATERIALIZED (SELECT src AS id, count(*) AS degree FROM h GROUP BY src)"""
PAIRS = """
pairs AS MATERIALIZED (SELECT a.l_partkey AS u, b.l_partkey AS v,
  CAST((a.l_partkey + b.l_partkey + a.l_linenumber) % 97 + 1 AS BIGINT) AS w
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"""
SQUARE = """m AS MATERIALIZED (SELECT DISTINCT l_partkey AS "row", l_suppkey AS "col" FROM lineitem)"""
INCIDENCE = """x AS MATERIALIZED (SELECT DISTINCT l_orderkey AS "row", l_suppkey AS "col" FROM lineitem)"""
TRIANGLES = """
t AS MATERIALIZED (SELECT x.u AS a, x.v AS b, y.v AS c FROM e x JOIN e y ON y.u = x.v JOIN e z ON z.u = x.u AND z.v = y.v),
tv AS MATERIALIZED (SELECT id, count(*) AS triangles FROM (SELECT unnest([a, b, c]) AS id FROM t) GROUP BY id)"""
