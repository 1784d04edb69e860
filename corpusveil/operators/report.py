"""Summaries, audit entries, metrics and batch results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Long form: key, entity_type, n."""
    return findings.groupBy(key, "entity_type").agg(F.count(F.lit(1)).alias("n"))


def rollup(findings: DataFrame, *keys: str) -> DataFrame:
    """Counts by the keys and entity type with all subtotals; null stands for all."""
    return findings.rollup(*keys, "entity_type").agg(F.count(F.lit(1)).alias("n"))


def count_type(findings: Column, entity_type: str) -> Column:
    return F.size(F.filter(findings, lambda f: f.entity_type == entity_type)).cast("long")


def summary_of(findings: Column, level: str) -> Column:
    """struct<total_findings, by_type, level_applied> of a nested findings column."""
    types = F.array_distinct(F.transform(findings, lambda f: f.entity_type))
    by_type = F.map_from_entries(F.transform(types, lambda t: F.struct(t, F.size(F.filter(findings, lambda f: f.entity_type == t)))))
    return F.struct(F.size(findings).alias("total_findings"), by_type.alias("by_type"), F.lit(level).alias("level_applied"))


def has_pii(findings: Column) -> Column:
    return F.size(findings) > 0


def audit(results: DataFrame, level: str, source: str = "batch") -> DataFrame:
    """One entry per file without any personal data. results: filename, content (binary),
    sanitized (binary, may be null or empty), findings, ms, error. The output hash is null for
    an empty output; the input hash is that of the real input also on errors."""
    ok = F.col("error").isNull()
    types = F.array_sort(F.array_distinct(F.transform("findings", lambda f: f.entity_type)))
    by_type = F.map_from_entries(F.transform(types, lambda t: F.struct(t, F.size(F.filter("findings", lambda f: f.entity_type == t)))))
    return results.select(
        F.current_timestamp().alias("timestamp"),
        F.uuid().alias("request_id"),
        F.sha2("content", 256).alias("input_hash"),
        "filename",
        F.length("content").cast("long").alias("file_size"),
        F.when(F.length("sanitized") > 0, F.sha2("sanitized", 256)).alias("output_hash"),
        F.lit(level).alias("level"),
        by_type.alias("findings_by_type"),
        F.coalesce(F.size("findings"), F.lit(0)).cast("long").alias("total_findings"),
        F.col("ms").cast("long").alias("processing_time_ms"),
        F.when(ok, "success").otherwise("error").alias("status"),
        F.col("error").alias("error"),
        F.lit(source).alias("source"),
        F.lit(None).cast("string").alias("client_ip"),
    )


def metrics(entries: DataFrame) -> DataFrame:
    """Totals over audit entries: requests, successes, failures, average time (rounded half-even)."""
    good = F.col("status") == "success"
    n = F.count(F.lit(1))
    return entries.agg(
        n.alias("requests_total"),
        F.count_if(good).alias("requests_success"),
        F.count_if(~good).alias("requests_failed"),
        F.bround(F.coalesce(F.sum("processing_time_ms"), F.lit(0)) / F.greatest(n, F.lit(1)), 0).cast("long").alias("avg_processing_time_ms"),
    )


def metrics_by_type(entries: DataFrame) -> DataFrame:
    return entries.select(F.explode("findings_by_type").alias("entity_type", "n")).groupBy("entity_type").agg(F.sum("n").alias("n"))


def batch_totals(results: DataFrame, key: str = "batch_id") -> DataFrame:
    """total_files, successful and failed per batch; a file fails when it has an error."""
    return results.groupBy(key).agg(F.count(F.lit(1)).alias("total_files"), F.count_if(F.col("error").isNull()).alias("successful"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def oversized_batches(files: DataFrame, most: int = 10, key: str = "batch_id") -> DataFrame:
    """Batches with more files than allowed; they are refused as a whole."""
    return files.groupBy(key).agg(F.count(F.lit(1)).alias("files")).filter(F.col("files") > most)


def response_json(df: DataFrame, fields: list[str]) -> Column:
    """The fields as JSON without those that are null."""
    return F.to_json(F.struct(*fields))


def log_line(level: Column, message: Column, **extra: Column) -> Column:
    """A JSON log line; null extras are left out."""
    return F.to_json(F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp"), level.alias("level"), message.alias("message"), *[v.alias(k) for k, v in extra.items()]))
