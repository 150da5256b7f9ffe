"""The queries of this package: one per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, backoff, bagminhash, bpe, fingerprint, html, lexical, mixing, packing, pii, quality, sentences, suffixes
from .common import documents
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]

#: A parameter of the queries: whose vocabulary to encode by.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir)).drop("n_lines", "source")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(documents(spark, sf_dir))


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(documents(spark, sf_dir))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.repeated_sentences(documents(spark, sf_dir), anywhere=True)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), RANKS, public_tokenizers.PATTERN, cache_size=250_000)  # memory is no concern here, seconds are
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_spans")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("source")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_next(documents(spark, sf_dir))


def op10_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score(documents(spark, sf_dir))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(documents(spark, sf_dir), WORDS)
    return packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_minhash": op2_minhash,
    "op3_suffixes": op3_suffixes,
    "op4_html": op4_html,
    "op5_sentences": op5_sentences,
    "op6_bpe": op6_bpe,
    "op7_pii": op7_pii,
    "op8_mixing": op8_mixing,
    "op9_fingerprint": op9_fingerprint,
    "op10_backoff": op10_backoff,
    "op11_search": op11_search,
    "op12_packing": op12_packing,
    "op13_audit": op13_audit,
}
