"""Exact dedup: group by a 128-bit content hash, keep one row by a stable rule, compare
bytes inside groups.

Equal means identical after deleting the white space of the word rule. A hash group is
trusted only when the smallest and the largest normalised text in it are the same bytes;
groups that fail (hash collisions) are grouped again by the whole normalised text.

Defined cases: a null text counts as empty, and all empty texts form one group. Of equal
texts the row with the most code points in its original text stays, then the smallest
doc_id; a null doc_id sorts after every other. Repeated rows (same id and text) are one
group whose keep_id they all share; `kept` is true on every row that has the winning id and
length, so callers that need one row per group use `dedup`. An empty table gives an empty
result. Input columns other than doc_id and text are not read.

Scale: hash and length are computed at the scan; the text itself is combined map-side to one
minimum and one maximum per task and group, so a group of a third of all rows leaves each
task as one row. The join back carries no text, and its skewed keys are split by AQE.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, text_of, without_space


def content_hash(normal: Column) -> Column:
    return F.unhex(F.md5(normal))


def _keys(docs: DataFrame, hashed: Callable[[Column], Column], text_col: str, id_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"), F.length(text).alias("_len"), without_space(text).alias("_normal")
    ).withColumn("_h", hashed(F.col("_normal")))


def _winner() -> Column:
    # max of (length, reversed id): ~id falls as id grows, nulls rank lowest.
    return F.max(F.struct(F.col("_len"), F.bitwise_not(F.col("doc_id")).alias("_nid"))).alias("_win")


def groups(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = _keys(docs, hashed, text_col, id_col)
    by_hash = durable(
        keys.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), _winner(), (F.min("_normal") != F.max("_normal")).alias("_clash")),
        "hash-groups",
    )
    rows = keys.select("doc_id", "_len", "_h", F.sha2("_normal", 256).alias("text_sha256"))
    found = rows.join(by_hash.filter(~F.col("_clash")), "_h")
    clashes = by_hash.filter("_clash").select("_h")
    if not clashes.isEmpty():
        texts = keys.join(clashes, "_h", "left_semi")
        by_text = texts.groupBy("_normal").agg(F.count(F.lit(1)).alias("_n"), _winner())
        apart = texts.withColumn("text_sha256", F.sha2("_normal", 256)).join(by_text, "_normal")
        found = found.unionByName(apart, allowMissingColumns=True)
    keep = F.bitwise_not(F.col("_win._nid"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("_len") == F.col("_win._len"))).alias("kept"),
        "text_sha256",
    )


def dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents that stay, in their own columns; repeated winning rows stay once. The join
    and the check for repeated rows share one exchange by id and text hash."""
    key = lambda i, sha: F.concat_ws("/", F.coalesce(i.cast("string"), F.lit("null")), sha)
    kept = groups(docs, text_col=text_col, id_col=id_col).filter("kept").select(key(F.col("keep_id"), F.col("text_sha256")).alias("__kept_key")).distinct()
    keyed = docs.withColumn("__kept_key", key(F.col(id_col), F.sha2(without_space(text_of(text_col)), 256)))
    return keyed.join(kept, "__kept_key", "left_semi").dropDuplicates(["__kept_key"]).drop("__kept_key")
