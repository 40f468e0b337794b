"""From raw documents to token ids: five stages over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, decontam, minhash, pii, quality
from tickloom.llm.common import Scratch, table

PII_KEY = "key-of-the-registered-pipeline"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; null texts and texts without a word go.

    The observed counts stand between verdict and filter: else Spark copies the whole
    scoring expression into the filter, once for each mention of a step below.
    """
    judged = quality.classify(docs).observe("quality_classifier", F.count(F.lit(1)).alias("seen"), F.count_if("_quality.kept").alias("kept"))
    return judged.where("_quality.kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of exact or near copies, whatever the ids; five words, similarity 0.8.

    Null and empty texts resemble nothing but equal rows; see ``minhash.one_of_each``.
    """
    return minhash.one_of_each(docs, k=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found; null, empty and repeated texts are judged like any, none is lost otherwise."""
    return decontam.contamination(docs, table(spark, sf_dir, "benchmark")).where(F.size("_found") == 0).select(*docs.columns)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data in their texts; n_chars follows the text. Null and empty texts stay as they are."""
    rows = pii.pseudonymised(docs, PII_KEY)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the hashes that prove the round trip; a null text has no tokens, equal rows equal ones."""
    rows = bpe.encoded(docs.select("doc_id", "text"), with_ids=True)
    return rows.select("doc_id", "_bpe.n_tokens", "_bpe.ids", "_bpe.ids_sha256", "_bpe.decoded_sha256")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_surrogates", pii_surrogates),
    ("byte_bpe", byte_bpe),
]

#: The trained scorer, hashing and merges are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written and read again as the next one's documents."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
