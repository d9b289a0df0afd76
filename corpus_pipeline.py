"""A training-data pipeline over ``documents``: five stages, each on all that the one before kept.

1. quality: the texts that the quality classifier rejects go.
2. near duplicates: one document of each class (five-word shingles, similarity 0.8) stays, the smallest doc_id.
3. secrets: every reported secret is masked in the text; no document goes.
4. mix: every document is repeated as often as the mix of the sources (weights 1, 2, 3) takes it.
5. tokens: every text is encoded; returns doc_id, ids, their number and digest, and the digest of the decoded bytes.

Stages hand over the columns of ``documents``. SQL cannot express the
classifier or the tokenizer, so there is no oracle; the tests hold each
stage against a brute-force version.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexiframe.llm import bpe, mixing, near_dedup, quality, secrets
from lexiframe.session import materialize, read_table

BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resample(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, BPE_RANKS, public_tokenizers.PATTERN, "doc_id", with_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("secrets", secrets_stage),
    ("mix", mix_stage),
    ("tokens", tokens_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; every stage but the last is written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
