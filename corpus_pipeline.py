"""The corpus pipeline: documents in, sharded training documents out.

Every stage takes (spark, docs, sf_dir), works on all that the stage before
kept, and returns a DataFrame that is written as Parquet and reread as the
next one's ``docs``.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botsift.llm.decontam import drop_contaminated
from botsift.llm.mixing import mixed_documents
from botsift.llm.neardup import drop_near_duplicates
from botsift.llm.quality import drop_low_quality
from botsift.llm.sharding import assign_shards
from botsift.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the tokeniser bands reject go."""
    return drop_low_quality(docs)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of its smallest
    doc_id (five-word shingles, similarity 0.8)."""
    return drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their targets."""
    return mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document copy gets a shard (0..15) and a slot in it; these
    columns take the place of columns of their names."""
    new = ["size", "text_crc32", "shard", "slot"]
    return assign_shards(docs).select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in new], *new)


STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_neardup", neardup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("vector_sharding", sharding_stage),
]

# The tokeniser measures and the packing have no SQL form; a test compares
# run() to a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
