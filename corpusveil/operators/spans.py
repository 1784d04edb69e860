"""Text assembled from placed spans, and findings resolved back to places.

Spans of a document are numbered by seq. Offsets are running sums over a window by document;
resolution is a join on the document with an overlap condition, so it hashes by document and
never compares spans of different documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")


def word_boxes(words: DataFrame, key: str = "doc_id") -> DataFrame:
    """Recognised words (key, seq, block, line, conf, text, left, top, width, height) as spans
    with their separator: words without confidence or letters are dropped; a new block begins
    with an empty line, a new line with a line break, any other word with a blank."""
    seen = words.filter((F.col("conf") >= 0) & (F.btrim("text") != ""))
    w = Window.partitionBy(key).orderBy("seq")
    block, line = F.lag("block").over(w), F.lag("line").over(w)
    sep = F.when(block.isNull(), "").when(block != F.col("block"), "\n\n").when(line != F.col("line"), "\n").otherwise(" ")
    return seen.select(key, "seq", sep.alias("sep"), "text", F.lit(0).alias("page"), F.col("left").alias("x0"), F.col("top").alias("y0"), (F.col("left") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"))


def with_offsets(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """start and end of each span in the assembled text; sep stands before a span."""
    before = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("sep") + F.length("text")).over(before).cast("int")
    return spans.withColumn("end", end).withColumn("start", F.col("end") - F.length("text"))


def assembled(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text: the spans of a document in order, each after its separator."""
    parts = F.sort_array(F.collect_list(F.struct("seq", F.concat("sep", "text").alias("part"))))
    return spans.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p.part), "").alias("text"))


def resolve(findings: DataFrame, placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each finding (key, finding, start, end) with every span that it touches: those with
    span.start < end and span.end > start."""
    s = placed.select(F.col(key).alias("_key"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("seq").alias("span_seq"), "page", *BOX)
    hit = (findings[key] == s["_key"]) & (s["_start"] < findings["end"]) & (s["_end"] > findings["start"])
    return findings.join(s, hit).drop("_key", "_start", "_end")


def located(findings: DataFrame, placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One page and box per finding: the page that most of its spans are on (of equals the one
    met first) and the box around its spans there; null where it touches none."""
    each = resolve(findings, placed, key).groupBy(key, "finding", "page").agg(F.count(F.lit(1)).alias("n"), F.min("span_seq").alias("first"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    best = each.groupBy(key, "finding").agg(F.max_by(F.struct("page", *BOX), F.struct("n", -F.col("first"))).alias("at"))
    return findings.join(best, [key, "finding"], "left").select(*findings.columns, "at.page", *[f"at.{c}" for c in BOX])


def is_scanned(text: Column, pages: Column, least: int = 10) -> Column:
    """Fewer than `least` stripped characters a page: the text layer is not to be trusted."""
    return F.length(F.btrim(text)) / F.greatest(pages, F.lit(1)) < least
