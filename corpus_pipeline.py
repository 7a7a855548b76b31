"""The corpus pipeline: each stage reads what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbtable.llm import exact_dedup, near_dedup, packing, private_data, quality_rules
from orbtable.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the target is what `labels` calls good."""
    return quality_rules.keep_good(docs, quality_rules.trusted_ids(spark, sf_dir))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one of the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by shingles of five words and similarity 0.8."""
    return near_dedup.keep_one(docs, width=5, percent=80)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with surrogates for private data."""
    return private_data.replace_private(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences; one row per piece of a document."""
    import public_tokenizers

    return packing.with_digest(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("private_data", private), ("packing", packed)]

#: SQL has no hashed weights, likelihoods, keyed surrogates or tokenizers; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
