"""A training-data pipeline over documents: five stages, each of which calls one operator of tidemark.llm.

Each stage takes the documents that its predecessor left, as a Parquet table, and what it decides takes effect: documents that the
quality classifier rejects go, one of each group of near-duplicates stays, documents that hold a benchmark item go, personal
data is replaced by its kind. The last stage encodes what is left and returns the tokens' digests.

Defined results of all stages: an empty table stays empty; a null or empty text is an empty one (as such it gets a score, is linked with nothing, holds no
item, has no spans and no tokens) and stays null or empty; very long texts are read whole; rows that repeat are judged alike, of equal
key and text the second stage keeps one; further columns pass the first four stages as they are, whatever their names and types.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontamination, near_dedup, pii, quality
from tidemark.llm.common import BATCH_BYTES, saved, shared_dir, small_batches, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.5; a tie with it stays. Without labels of both classes all stay if most labels are good, or there is none."""
    small_batches(spark, BATCH_BYTES)
    model = quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.accepted(docs, model)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8, that of the least doc_id; those with a null doc_id all, but none twice."""
    small_batches(spark, BATCH_BYTES)
    return near_dedup.deduplicated(docs, width=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty items are in none."""
    small_batches(spark, BATCH_BYTES)
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; n_chars, where there is one, follows the new text."""
    small_batches(spark, BATCH_BYTES)
    redacted = pii.redact(docs)
    return redacted.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else redacted


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document, whose ids decode to its text."""
    small_batches(spark, BATCH_BYTES)
    return bpe.digests(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("minhash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("pii", pii_redaction),
    ("byte-level bpe", bpe_encoding),
]

#: Compressed sizes, soft labels and merges in rank order are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"{folder}/{k}")
    return docs
