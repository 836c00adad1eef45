"""Sharding by a hypergeometric communication matrix.

A uniform shuffle into shards of exact sizes, without sorting the whole table:
how many rows of input partition p go to shard s is drawn from the multivariate
hypergeometric law that a uniform shuffle would give, each partition deals its
rows out in a random local order, rows are exchanged, and every shard permutes
what it got.  The matrix has one row a partition and is all the driver holds.

All draws depend on ``seed`` and on a row number fixed by a written table, so a
task that is run again deals the same rows the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import boxed, col, cut_lineage, unboxed

#: numpy's sampler takes populations below this.
_NUMPY_LIMIT = 10**9
#: About so many rows of a shard are permuted by one window group.
ROWS_PER_GROUP = 1 << 16


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` without replacement, for populations of any size.

    Beyond numpy's limit by inversion: the law's weights around its mean, by the
    exact ratio of neighbours, over 14 standard deviations to either side.
    """
    total = good + bad
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if draws == total:
        return good
    if total < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws))
    mean = draws * good / total
    sd = (mean * (bad / total) * ((total - draws) / max(total - 1, 1))) ** 0.5
    lo, hi = max(0, draws - bad, int(mean - 14 * sd) - 40), min(good, draws, int(mean + 14 * sd) + 40)
    k = np.arange(lo, hi, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weights = np.concatenate(([0.0], np.cumsum(steps)))
    cdf = np.cumsum(np.exp(weights - weights.max()))
    return lo + int(np.searchsorted(cdf, rng.random() * cdf[-1], "right"))


def communication_matrix(rows: list[int], capacities: list[int], seed: int) -> np.ndarray:
    """Counts from each partition (rows) to each shard (capacities), as a uniform shuffle would give them."""
    rng, left = np.random.default_rng(seed), list(capacities)
    out = np.zeros((len(rows), len(left)), np.int64)
    for p, n in enumerate(rows):
        pool, want = sum(left), n
        for s, room in enumerate(left):
            pool -= room
            got = hypergeometric(rng, room, pool, want)
            out[p, s] = got
            left[s] -= got
            want -= got
    return out


def shard_sizes(total: int, n_shards: int) -> list[int]:
    """Sizes that differ by one at most, the larger first."""
    return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]


def assign(rows: DataFrame, n_shards: int, seed: int = 42) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 in each shard) to every row.

    ``rows`` should be narrow (ids and sizes; texts can be joined or written
    later): it is written once to the checkpoint folder, which fixes row numbers.
    Rows are dealt by place, never by value, so nulls, ties, repeated rows and hot
    groups are as good as any others.  An empty table gives an empty result.  Input
    columns named ``shard`` or ``slot`` are replaced, all others pass through.
    """
    spark = rows.sparkSession
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    base = cut_lineage(rows.select(boxed(rows, names), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("n")))
    counts = {r["p"]: r["n"] for r in base.groupBy("p").agg(F.count("*").alias("n")).collect()}  # one a partition
    parts, total = sorted(counts), sum(counts.values())
    matrix = communication_matrix([counts[p] for p in parts], shard_sizes(total, n_shards), seed)
    shared = spark.sparkContext.broadcast({p: matrix[i] for i, p in enumerate(parts)})
    kind = np.min_scalar_type(max(n_shards - 1, 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hands: dict[int, np.ndarray] = {}
        for batch in batches:
            part = batch.column(1).to_numpy()
            # a partition's rows are numbered in order from p << 33
            place, shard = batch.column(2).to_numpy() & ((1 << 33) - 1), np.empty(batch.num_rows, np.int32)
            for p in np.unique(part).tolist():
                if p not in hands:
                    hands[p] = np.random.default_rng((seed, 1, p)).permutation(np.repeat(np.arange(n_shards, dtype=kind), shared.value[p]))
                at = part == p
                shard[at] = hands[p][place[at]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(shard)], names=["row", "n", "shard"])

    dealt = base.mapInArrow(deal, StructType([base.schema["row"], base.schema["n"], StructField("shard", IntegerType())]))
    # A random key orders each shard; its upper part cuts the shard into groups that are permuted one by one.
    n_groups = max(1, -(-total // (n_shards * ROWS_PER_GROUP)))
    keyed = dealt.select("row", "shard", "n", F.xxhash64("n", F.lit(seed)).alias("key"), F.pmod(F.xxhash64("n", F.lit(seed + 1)), F.lit(n_groups)).cast("int").alias("g"))
    sizes = keyed.groupBy("shard", "g").agg(F.count("*").alias("m"))
    before = Window.partitionBy("shard").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "g", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    local = F.row_number().over(Window.partitionBy("shard", "g").orderBy("key", "n")) - 1
    placed = keyed.select("row", "shard", "g", local.alias("local")).join(offsets, ["shard", "g"])
    return placed.select(*unboxed(names), "shard", (F.col("offset") + F.col("local")).alias("slot"))


def document_rows(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Narrow rows to deal: the id, the size (UTF-8 bytes and 8; null: 8) and the text's CRC-32 (null: 0)."""
    data = F.coalesce(col(text_col).cast("binary"), F.lit(b""))
    return docs.select(col(id_col).alias("doc_id"), (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
