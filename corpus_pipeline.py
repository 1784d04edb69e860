"""Five of the training-data operators in a row: quality rules, exact dedup, near dedup,
mixing along the curriculum, and byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusveil.llm import bpe, exact_dedup, mixing, quality, simhash
from corpusveil.llm.common import documents, durable


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line-first rules, without their failing lines."""
    kept = quality.clean(docs)
    # The table's own count of characters follows the text.
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints."""
    return simhash.dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, in training order."""
    return mixing.curriculum_order(docs, position_col="__position").drop("__position")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row that is left, and its place in the training order: the
    number of the range-sorted table's file and the row in it (null if docs was not read from files)."""
    try:
        of_file = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
        placed = docs.select("*", of_file.alias("__part"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        placed = docs.select("*", F.lit(None).cast("int").alias("__part"), F.lit(None).cast("long").alias("__row"))
    coded = bpe.code(placed, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, more=("__part", "__row"))
    return bpe.digest(coded).withColumnsRenamed({"__part": "order_part", "__row": "order_row"})


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact), ("simhash_dedup", near), ("mixing", mixed), ("byte_bpe", encoded)]

#: Fingerprints and ids are beyond SQL; tests/llm checks run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and reread by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
