"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of documents per Arrow batch: texts can be long, so batches stay short.
BATCH_ROWS = 1000


def session_defaults(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small; results never depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def col(name: str) -> Column:
    """The column of exactly this name, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores before it until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def boxed(df: DataFrame, names: list[str] | None = None) -> Column:
    """The columns ``names`` (all) as one struct ``row``, beside which working columns may have any names."""
    return F.struct(*[col(c) for c in (df.columns if names is None else names)]).alias("row")


def unboxed(names: list[str]) -> list[Column]:
    """The columns of ``boxed``, again by themselves."""
    return [F.col("row").getField(c).alias(c) for c in names]


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n`` (null ids count as '')."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors see.

    Only a local master, whose one process needs no sharing, may leave it unset.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back from there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let the shuffle files and checkpoints go that only finished plans refer to.

    Spark removes them when the driver's JVM collects its garbage; left to itself that
    follows the driver's heap, not the disk, and files of many steps stand side by side.
    """
    for pause in (0.5, 0.3):  # events of the last job hold its plan for a moment
        time.sleep(pause)
        gc.collect()
        spark._jvm.System.gc()


def content_key(*cols: Column | str) -> list[Column]:
    """Two 64-bit hashes that stand for a row's values (128 bits, so no chance meeting).

    Unlike a row number it is the same in every scan of the table, so decisions
    can be joined back to rows; rows equal in all of ``cols`` share their key.
    """
    return [F.xxhash64(*cols).alias("__k1"), F.xxhash64(F.lit("b"), *reversed(cols), F.lit(7)).alias("__k2")]


#: A side of a join is broadcast when a count shows at most so many rows (narrow ones, so some tens of MB).
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow, already written table for broadcast if it is small; else leave the join to be shuffled."""
    return F.broadcast(df) if df.count() <= limit else df
