"""A training-data pipeline over ``documents``: filter, deduplicate, redact, mix, encode.

Every stage takes all rows its predecessor kept and is written before the next one reads it. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chargeweave.llm import bpe, minhash, mixing, pii, quality
from chargeweave.session import ensure_folder, stage

#: Near copies share this part of their five-word shingles, or more.
NEAR_PERCENT = 80
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose own measures and whose host pass the quality rules."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.keep_one(docs, NEAR_PERCENT)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by the names of its kinds."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once or twice."""
    return mixing.apply_copies(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids instead of the text."""
    return bpe.encode(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", keep_good),
    ("MinHash near-dedup", near_dedup),
    ("PII", redact),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
