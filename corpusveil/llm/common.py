"""What the training-data operators share: columns, durable tables, the word rule."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import let

__all__ = ["SPACE_CLASS", "WORD", "documents", "durable", "empty_shared", "let", "new_path", "shared_dir", "text_of", "without_space", "words_of"]

#: ASCII white space as the word rule names it: space and TAB to CR.
SPACE_CLASS = r"[ \t-\r]"
WORD = r"[^ \t-\r]+"
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary
    folder where that is unset (local mode and tests only)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="corpusveil-")
        spark.conf.set("spark.checkpoint.dir", at)
    # With its scheme, so that readers outside Spark find the same store.
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    full = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/corpusveil/{what}-{uuid.uuid4().hex}"


#: With this on, Spark removes an execution's shuffle files once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def empty_shared(spark: SparkSession) -> None:
    """Deletes all tables and files that the operators have left in the shared folder. Results that
    were not written elsewhere cannot be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/corpusveil")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that what follows neither
    recomputes it nor depends on one executor's disk. Its shuffle files go at once."""
    spark, path = df.sparkSession, new_path(df.sparkSession, what)
    was = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def without_space(text: Column) -> Column:
    """Deletes every character of the word rule's white space; plain byte scans, no regex."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    """Array of maximal runs outside the word rule's white space."""
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
