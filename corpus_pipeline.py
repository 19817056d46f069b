"""The corpus pipeline: five stages, each calling one operator of ``factweave.llm``.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its result is written as
Parquet and read again as the next stage's documents.  All stages but the last return the
columns of ``documents`` and decide which rows stay; the last one returns sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factweave.llm import exact_dedup, mixing, ngram_join, packing, quality_rules
from factweave.llm.common import discard, keep_rows, materialize


def stage_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the repetition limits reject go."""
    return quality_rules.quality_rules(docs, passthrough=True)


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id stays."""
    return keep_rows(docs, exact_dedup.exact_dedup(docs).where("kept"))


def stage_ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the smallest doc_id stays."""
    found = ngram_join.ngram_join(docs, k=5, threshold=(80, 100))
    return keep_rows(docs, found.where("kept"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document's row once for each reading the mix takes; sources near their targets."""
    return mixing.mixed_documents(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", stage_quality_rules),
    ("exact_dedup", stage_exact_dedup),
    ("ngram_join", stage_ngram_join),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]

#: Suffix arrays, similarity joins and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to shared storage and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        made = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if i:
            discard(docs)  # the stage before; nothing reads it again
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
