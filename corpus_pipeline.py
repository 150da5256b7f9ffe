"""A corpus pipeline of five stages over ``documents``: quality rules, near-dedup, personal data, mixing, encoding.

Every stage takes null texts as empty and null sources as a source, keeps null keys, and gives no rows for none; rows that
repeat are judged each, until near-dedup keeps one of them. Further columns, whatever their names, are carried to the last stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bagminhash, bpe, mixing, pii, quality
from palimpsest.llm.common import documents, shared_folder

#: A parameter: whose vocabulary to encode by.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.keep_good(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return bagminhash.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind, and ``n_chars`` counted again (null for a null text)."""
    return pii.redact(docs).select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and token_ids (decimal, joined by spaces) of each row, whether the ids decode to the text again."""
    coded = bpe.round_trip(docs.selectExpr("doc_id", "source", "text", "sha2(coalesce(text, ''), 256) AS digest"), RANKS, public_tokenizers.PATTERN)
    return coded.selectExpr("doc_id", "source", "n_tokens", "token_ids", "sha2(decoded, 256) = digest AS round_trip")


STAGES = [
    ("quality rules", quality_stage),
    ("near-dedup", dedup_stage),
    ("personal data", pii_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: No SQL states signatures, classes and merges; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's rows are written as Parquet in the shared folder and read again for the next."""
    docs, folder = documents(spark, sf_dir), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
