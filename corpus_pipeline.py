"""Corpus pipeline: documents through five stages, each written and reread.

Quality rules, exact dedup, near-dedup, source mixing, token encoding. Every
stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import exact_dedup, golay_simhash, merge_rounds, mixing, quality_rules
from tidewatch.llm.queries import tokenizer_path
from tidewatch.plans.panel import table
from tidewatch.session import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    trusted = quality_rules.trusted_ids(table(spark, sf_dir, "labels"), quality_rules.QualityConfig())
    return quality_rules.keep_good(docs, trusted)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-equal fingerprints the one with the smallest id stays."""
    return golay_simhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often (0, 1 or 2 times) as the mix takes it."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, digested, with their decoding."""
    return merge_rounds.round_trip(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("source mixing", mix),
    ("sentencepiece", encode),
]

#: The score, fingerprint and tokenizer have no SQL form; tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
