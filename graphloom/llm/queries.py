"""The corpus operators bound to the checker's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, license_scan, line_dedup, quality, sharding, simhash, toxicity, url_filter
from .common import id_bucket, session_defaults

#: Names in the public_tokenizers package.
BPE_RANKS, PIECES = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"
N_SHARDS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    session_defaults(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs, labels, usable=~toxicity.held_out())


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model, score_col="score")
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(docs).drop("text", "blocks")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return decontam.contaminated_pairs(docs, items)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, tokenizer_path(BPE_RANKS), bpe_pattern()).drop("text")


def op5_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return quality.judge(docs).select("doc_id", *quality.STATS, "base_failed", "kept")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.document_rows(table(spark, sf_dir, "documents"))
    out = sharding.assign(rows, N_SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.decide(table(spark, sf_dir, "documents").select("doc_id", "text"))
    dropped = F.transform("dropped", lambda x: x.cast("string"))
    return out.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join(dropped, ",").alias("dropped_lines"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages have no fetch time; day 0 to 364 of 2024 by page_id stands in for it."""
    return pages.select("page_id", "url", F.expr("date_add(date '2024-01-01', cast(page_id % 365 as int))").alias("fetched"))


def list_events(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts and parent domains of the pages.

    The MD5 of an entry decides whether it is ever listed, when, for how long,
    and whether it is listed again.
    """
    entry = F.explode(F.expr(url_filter.suffixes())).alias("entry")
    hosts = pages.select(url_filter.host_of().alias("host")).where("host is not null").distinct()
    digits = [f"ascii(substr(md5(entry), {i}, 1))" for i in (1, 2, 3, 4)]
    entries = hosts.select(entry).where("entry like '%.%'").distinct().selectExpr("entry", *[f"{x} as d{i}" for i, x in enumerate(digits)])
    start, span = "(d1 * 7 + d2 * 3) % 300", "20 + d3 % 90"
    category = F.expr("case d0 % 3 when 0 then 'adult' when 1 then 'malware' else 'spam' end").alias("category")
    listed = entries.where("d0 % 2 = 0").withColumn("__start", F.expr(start)).withColumn("__span", F.expr(span))
    event = "named_struct('listed', {}, 'at', date_add(date '2024-01-01', {}))"
    events = F.expr(f"array({event.format('true', '__start')}, {event.format('false', '__start + __span')}, {event.format('true', '__start + __span + 30')})")
    return listed.select("entry", category, F.explode(events).alias("e")).select("entry", "category", "e.listed", "e.at")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter.filter_captures(captures_of(pages), list_events(pages))
    return out.withColumn("fetched", F.col("fetched").cast("string"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_bucket(F.col("doc_id"), 4) == 2
    model = langid.fit(docs, langid.vocabulary_pieces(tokenizer_path(PIECES)), usable=~held_out)
    out = langid.predict(docs.drop("lang"), model, score_col="score")
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def queries():
    return {f.__name__: f for f in (op1_toxicity, op2_license_scan, op3_decontamination, op4_byte_bpe, op5_robust_quality, op6_sharding, op7_simhash, op8_line_dedup, op9_url_filter, op10_language_id)}



def oracle_sql() -> dict[str, str]:
    from . import oracle

    return oracle.oracle_sql()
