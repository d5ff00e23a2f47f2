"""A corpus pipeline of the training-data operators: rules, near-duplicates, secrets, mix, pieces.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``; other columns are ignored. Every stage works on all that the one before it kept:
repeated rows are rows of their own but in near-duplicates, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trailweave.llm import mixing, near_dedup, pieces, quality, secrets
from trailweave.llm.common import fresh_path, remove, table

#: Rows of whole texts that Spark hands to Python at a time; its default of 10,000 would hold tens of megabytes of long texts several times over.
BATCH = 1000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The order in which Newton's steps and rounding meet documents can't be had in SQL, nor can the model's verdicts.
ORACLE_SQL = None


def _chosen(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, and small batches from here on."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(BATCH, now) if now > 0 else BATCH)
    return docs.select(COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the rules and their language's perplexity band. A null or empty text fails; a null language is one of its own."""
    return quality.accepted(_chosen(spark, docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the least doc_id, of equal ids that with the least text, once.

    Texts without a word are alone and stay; a null doc_id comes after all others.
    """
    return near_dedup.deduplicated(_chosen(spark, docs))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows. A null text stays null, with its n_chars."""
    clean = secrets.redacted(_chosen(spark, docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, as whole copies; those of no copy go.

    A null or empty text has size 0, weighs nothing and stays once; a null source is one of its own; equal sizes are taken in the order of a hash.
    """
    return mixing.mixed(_chosen(spark, docs))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces, ids, other_ids of every document: its best and second best pieces, which a model is trained on; null of a null text."""
    return pieces.encoded(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing", mixing_weights),
    ("piece encoding", piece_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, over ``documents``; each result is written to the shared checkpoint folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
