"""Matrix Market coordinate files, pattern or integer (values are dropped)."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Matrix

BANNER = re.compile(r"%%MatrixMarket\s+matrix\s+coordinate\s+(pattern|integer)\b", re.IGNORECASE)


def read_mtx(spark: SparkSession, path: str, check: bool = True) -> Matrix:
    """Read a file, or a folder of parts one of which has the header, into 0-based entries.

    Raises ValueError on another banner or, with ``check``, a wrong entry count.
    Parts may be read in any order: the header is looked for where the banner stands.
    """
    read = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    lines = read.where("line <> ''")
    banners = lines.where("startswith(line, '%%')").limit(2).collect()
    if len(banners) != 1 or not BANNER.match(banners[0]["line"]):
        raise ValueError(f"{path}: not a coordinate matrix of pattern or integer entries")
    body = lines.where("not startswith(line, '%')")
    size = body.where(F.col("file") == banners[0]["file"]).orderBy("block", "n").first()
    if size is None or len(size["line"].split()) < 3:
        raise ValueError(f"{path}: no size line")
    rows, cols, nnz = map(int, size["line"].split()[:3])
    fields = F.split("line", r"\s+")
    header = (F.col("file") == size["file"]) & (F.col("block") == size["block"]) & (F.col("n") == size["n"])
    entries = body.where(~header).select((fields[0].cast("long") - 1).alias("row"), (fields[1].cast("long") - 1).alias("col"))
    if check:
        bad = entries.agg(F.count("*").alias("n"), F.count(F.when((F.col("row") < 0) | (F.col("row") >= rows) | (F.col("col") < 0) | (F.col("col") >= cols), 1)).alias("out")).first()
        if bad["n"] != nnz or bad["out"]:
            raise ValueError(f"{path}: {bad['n']} entries, {bad['out']} of them out of range; the header says {nnz}")
    return Matrix(entries, rows, cols)


def write_mtx(m: Matrix, path: str, single: bool = False) -> None:
    """Write a folder of text parts whose first file starts with the banner and size; entries are 1-based and sorted.

    ``single`` writes one part, a file that any reader of the format takes; one task sorts it.
    """
    spark = m.entries.sparkSession
    nnz = m.entries.count()
    head = spark.createDataFrame([(0, -2, "%%MatrixMarket matrix coordinate pattern general"), (0, -1, f"{m.numrows} {m.numcols} {nnz}")], "r long, c long, value string")
    body = m.entries.select((F.col("row") + 1).alias("r"), (F.col("col") + 1).alias("c")).withColumn("value", F.concat_ws(" ", "r", "c"))
    lines = head.union(body)
    # range partitions are written in order, so the parts read one after another are the file
    dealt = lines.coalesce(1) if single else lines.repartitionByRange("r", "c")
    dealt.sortWithinPartitions("r", "c").select("value").write.text(path)


def write_metadata(m: Matrix, path: str, writers: int = 1) -> None:
    """The matrix's shape, entry count and number of writers as one JSON row."""
    row = {"numrows": m.numrows, "numcols": m.numcols, "nnz": m.entries.count(), "nwriters": writers}
    m.entries.sparkSession.createDataFrame([(json.dumps(row),)], "value string").coalesce(1).write.text(path)


def read_metadata(spark: SparkSession, path: str) -> dict[str, int]:
    return json.loads(spark.read.text(path).first()["value"])


def write_dataset(m: Matrix, path: str, writers: int = 1) -> None:
    """Entries as Parquet beside their metadata."""
    m.entries.write.parquet(f"{path}/entries")
    write_metadata(m, f"{path}/metadata", writers)


def read_dataset(spark: SparkSession, path: str) -> Matrix:
    meta = read_metadata(spark, f"{path}/metadata")
    return Matrix(spark.read.parquet(f"{path}/entries"), meta["numrows"], meta["numcols"])
