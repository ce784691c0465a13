"""The corpus pipeline: quality rules, near-dedup, decontamination, secret scans, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Rows that a stage keeps
carry all columns of ``docs``; the last stage returns ids and text. Statistical models are fitted
on the stage's own input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rampart.llm import bpe, dart_minhash, decontaminate, quality, secret_scan
from rampart.llm.common import Shared

#: SQL can express neither the dart signatures nor the trained models; tests/llm holds brute-force versions.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; so do null texts."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document of the least doc_id stays."""
    return dart_minhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced, and n_chars follows."""
    return secret_scan.redact(docs, secret_scan.model(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed, little-endian unsigned 32-bit), text (decoded from the ids again)."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, decoded="text", keep=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokenize", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet and read again."""
    shared = Shared(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = shared.save(stage(spark, docs, sf_dir), name)
        if i:
            shared.drop(STAGES[i - 1][0])
    return docs
