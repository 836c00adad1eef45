"""Edge dumps, k-mer sample files and generated edge lists on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import csr_to_coo, orient

NUMBER = r": ([0-9]+)"


def numbers(lines: DataFrame, name: str) -> DataFrame:
    """(pos, name): the integers after ``: `` in a dump's lines (pos, value); other lines do not count."""
    return lines.select("pos", F.regexp_extract("value", NUMBER, 1).alias("x")).where("x <> ''").select("pos", F.col("x").cast("long").alias(name))


def edge_dump_to_coo(targets: DataFrame, offsets: DataFrame) -> DataFrame:
    """(hi, lo), 1-based, from dumped targets (pos, col) and row offsets (row, offset, next_offset)."""
    rows = offsets.where("next_offset > offset").select("row", "offset", (F.col("next_offset") - F.col("offset")).alias("degree"))
    e = csr_to_coo(rows, targets).select((F.col("row") + 1).alias("u"), (F.col("col") + 1).alias("v"))
    return orient(e)


def write_kmer_samples(incidence: DataFrame, path: str) -> None:
    """One folder a sample (col) with its k-mers (row), and the list of samples."""
    incidence.select(F.col("row").cast("string").alias("value"), "col").write.partitionBy("col").text(f"{path}/samples")
    incidence.select(F.concat(F.lit("col="), F.col("col").cast("string")).alias("value")).distinct().write.text(f"{path}/manifest")


def read_kmer_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(f"{path}/samples").select(F.col("value").cast("long").alias("row"), F.col("col").cast("long").alias("col"))


def write_edges(edges: DataFrame, path: str, reuse: bool = False) -> None:
    """Generated edges (and weights, if there) as Parquet; ``reuse`` keeps a table that is there already."""
    edges.write.mode("ignore" if reuse else "errorifexists").parquet(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
