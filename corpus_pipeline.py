"""Documents to training sequences: the stages, in order, over everything the stage before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.decontamination import contaminated
from tessera.llm.language import keep_identified
from tessera.llm.minhash import near_duplicates
from tessera.llm.packing import pack
from tessera.llm.quality import keep_good
from tessera.session import materialise


ROWS, BYTES = "1000", str(4 << 20)  # whole texts are long rows: small batches keep the Python workers' memory bounded


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality and toxic ones go."""
    small_batches(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in which no language prevails, go."""
    small_batches(spark)
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id. Rows without an id stay."""
    small_batches(spark)
    kept = near_duplicates(docs, width=5, percent=80).where("kept and doc_id is not null").select("doc_id")
    unnamed = docs.where("doc_id is null")
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(unnamed)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go. Rows without an id stay."""
    small_batches(spark)
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of at most 2048 tokens."""
    small_batches(spark)
    # Workers outlive the stage, so they keep little: the other stages share their memory.
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), cached=100_000, keep=False)


STAGES = [
    ("quality_classifier", quality),
    ("language_id", language),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("packing", packing),
]
ORACLE_SQL = None  # trained models and tokenizers have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
