"""A training-data pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what
a stage returns as Parquet in the shared folder and reads it again for the next.
All stages but the last return the columns of documents.  An empty table passes
through all stages; extra columns of documents, whatever their names, are kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontam, line_dedup, queries, simhash, toxicity
from graphloom.llm.common import col, free_name, release, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go.

    A score depends on the whole text alone: null and empty texts score as no words and
    stay, repeated rows go or stay together.  Labels of ids that stand on several rows
    count once.
    """
    queries.session_defaults(spark)
    model = queries.toxicity_model(docs, queries.table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return toxicity.score(docs, model, score_col=score).where(col(score) < 0.5).select(*[col(c) for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go from the texts; every document stays.

    The line of the smallest doc_id stays (null ids come last); of rows equal in id and
    text one counts as the first.  Null texts stay null, blank lines stay, and a text all
    of whose lines go becomes empty.  n_chars is counted anew.
    """
    queries.session_defaults(spark)
    return line_dedup.deduplicate(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash and 5-word overlap links stays, that with the smallest doc_id.

    Null and empty texts are one component; of repeated rows one stays; of rows that tie
    in doc_id the one with the smallest hash of its text does.
    """
    queries.session_defaults(spark)
    return simhash.deduplicate(docs, overlapping=True)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item go; null, empty and very short texts cover none and stay.

    Every row is judged by its whole text alone, so repeated rows go or stay together.
    """
    return decontam.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes join the columns; the text stays.

    Null and empty texts have no tokens and the digests of nothing; every row stays.
    Columns of documents named like one of the three are replaced.
    """
    queries.session_defaults(spark)
    return bpe.round_trip(docs, queries.tokenizer_path(queries.BPE_RANKS), queries.bpe_pattern())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("decontamination", decontaminate),
    ("byte_bpe", tokenize),
]

#: Scores, fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; intermediate tables go to the shared folder.

    A stage's table is removed when the next one is written; the last one is what is returned.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{i}-{name}")
        docs = spark.read.parquet(path)
        if before is not None:
            _remove(spark, before)
        release(spark)
        before = path
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
