"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, PII, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendorlens.llm import decontamination, near_dedup, packing, pii, toxicity
from vendorlens.llm.common import saved, small_batches, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. Labels are learned as in the registered query: not from held-out rows."""
    small_batches(spark)
    learnable = F.crc32(F.col("_id").cast("string")) % 4 != 2
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"), usable=learnable)
    return toxicity.acceptable(docs, model, threshold=0.3)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    small_batches(spark)
    return near_dedup.deduplicated(docs, every_row=True, width=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten words in a row of a benchmark item, or a whole item of fewer words."""
    small_batches(spark)
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"), width=10)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by its kind; n_chars follows the text."""
    small_batches(spark)
    return pii.redacted(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    small_batches(spark)
    pieces = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_copies),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("packing", into_sequences),
]

#: A trained classifier and a trained tagger decide, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each over the Parquet output of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
