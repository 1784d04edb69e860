"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, exact_dedup, licences, lm, mixing, passages, pii, quality, simhash
from .common import documents


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.quality(documents(spark, sf_dir)))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digest(licences.scan(documents(spark, sf_dir)))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(documents(spark, sf_dir))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.findings(documents(spark, sf_dir)))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).drop("component_size")


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.preferences(*chat.off_topic_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.digest(passages.passages(documents(spark, sf_dir)))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_held_out(documents(spark, sf_dir))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest(bpe.code(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_simhash": op2_simhash,
    "op7_preferences": op7_preferences,
    "op8_passages": op8_passages,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_byte_bpe": op10_byte_bpe,
    "op3_mixing": op3_mixing,
    "op4_quality_rules": op4_quality_rules,
    "op5_licences": op5_licences,
    "op6_exact_dedup": op6_exact_dedup,
}
