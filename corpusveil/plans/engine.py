"""One lazy plan per request: files or texts in, findings, redacted content and summary out."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SanitizeConfig
from ..functions import fixed
from ..operators import detect, merge, pixels, redact, report, visual
from ..sources import formats, parsers, providers

TEXT_MIMES = ("text/plain", "text/markdown")


def final_findings(found: DataFrame) -> Column:
    """The merged findings where a named-entity layer has run, else the patterns' own."""
    return F.col("merged") if "merged" in found.columns else F.col("findings")


class Engine:
    """All methods only build plans; nothing runs until a result is read or written."""

    def __init__(self, cfg: SanitizeConfig = SanitizeConfig()):
        self.cfg = cfg

    # texts ---------------------------------------------------------------------------------

    def detect(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs plus findings; with a named-entity provider registered, merged findings too."""
        found = detect.with_findings(docs, self.cfg, text_col)
        if providers.available("ner"):
            found = merge.with_layer(providers.provider("ner").predict(found, tuple(fixed.LABELS)), threshold=self.cfg.ner_threshold)
        return found

    def sanitize(self, docs: DataFrame, text_col: str = "text", key: str = "doc_id", fast: bool = False) -> DataFrame:
        """docs plus findings, sanitized (null for the json response), summary, output_filename
        where there is a filename. fast cuts by offset instead of by repeated search (merged
        findings have no offsets and are searched)."""
        found = self.detect(docs, text_col)
        used = final_findings(found)
        chosen = F.filter(used, lambda f: redact.is_redacted(f.entity_type, self.cfg.redact_entities))
        clean = (redact.redact_offsets if fast and "merged" not in found.columns else redact.redact_text)(F.col(text_col), chosen, self.cfg.style)
        if self.cfg.response == "json":
            clean = F.lit(None).cast("string")
        out = found.withColumns({"sanitized": clean, "summary": report.summary_of(used, self.cfg.level)})
        return out.withColumn("output_filename", redact.output_filename(F.col("filename"))) if "filename" in docs.columns else out

    def check_pii(self, docs: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
        """key, has_pii, total_findings at the strict level."""
        found = Engine(replace(self.cfg, level="strict")).detect(docs, text_col)
        used = final_findings(found)
        return found.select(key, report.has_pii(used).alias("has_pii"), F.size(used).alias("total_findings"))

    # files ---------------------------------------------------------------------------------

    def extract(self, files: DataFrame) -> DataFrame:
        """files (doc_id, filename, content) plus mime, category, text, pages, error. Plain text
        is decoded natively; other types are split off and go through the parsers."""
        typed = files.withColumn("mime", formats.resolve_mime(F.col("filename"), F.col("content"))).withColumn("category", formats.category(F.col("mime")))
        refused = formats.gate(F.length("content"), F.col("mime"), self.cfg.max_file_size)
        typed = typed.withColumn("refused", refused)
        plain = F.coalesce(F.col("mime").isin(*TEXT_MIMES), F.lit(False)) & F.col("refused").isNull()
        none = lambda kind: F.lit(None).cast(kind)
        native = typed.filter(plain).withColumns({"text": formats.decoded(F.col("content")), "pages": F.lit(1), "error": none("string")})
        bad = typed.filter(F.col("refused").isNotNull()).withColumns({"text": none("string"), "pages": none("int"), "error": F.col("refused")})
        rest = parsers.extract(typed.filter(~plain & F.col("refused").isNull()))
        return native.unionByName(rest).unionByName(bad).drop("refused")

    def sanitize_files(self, files: DataFrame) -> DataFrame:
        """extract, detect, rewrite: files plus findings, sanitized (binary), output_filename, status."""
        found = self.detect(self.extract(files))
        chosen = F.filter(final_findings(found), lambda f: redact.is_redacted(f.entity_type, self.cfg.redact_entities))
        ready = found.withColumn("_all", F.col("findings")).withColumn("findings", chosen)
        good = parsers.sanitized(ready.filter(F.col("error").isNull()), self.cfg.style)
        bad = ready.filter(F.col("error").isNotNull()).withColumns({"sanitized": F.lit(None).cast("binary"), "sanitize_error": F.lit(None).cast("string")})
        out = good.unionByName(bad).withColumn("findings", F.col("_all")).drop("_all")
        error = F.coalesce("error", "sanitize_error")
        return out.withColumns({"error": error, "status": F.when(error.isNull(), "success").otherwise("error"), "output_filename": redact.output_filename(F.col("filename"))}).drop("sanitize_error")

    def visual(self, images: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """Signatures in PNG images, and faces where a provider finds them: keys, entity_type, box,
        score. At the strict level only."""
        found = pixels.signatures(images, self.cfg.level, keys)
        if self.cfg.level == "strict" and providers.available("face"):
            found = found.unionByName(visual.faces(providers.provider("face").regions(images)).select(*found.columns))
        return found

    def sanitize_images(self, images: DataFrame, key: str = "doc_id") -> DataFrame:
        """images (key, content: PNG) plus findings (boxes) and sanitized (PNG, boxes filled)."""
        boxes = self.visual(images, (key,)).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("x0", "y0", "x1", "y1", "entity_type", "score"))).alias("findings"))
        return pixels.blacked(images.join(boxes, key, "left"), F.col("findings"))

    def full_response(self, results: DataFrame) -> DataFrame:
        """Results with the content as base64, and nulls left out of the JSON."""
        return results.select("doc_id", F.to_json(F.struct("filename", "status", "error", F.base64("sanitized").alias("file"))).alias("response"))


def register_views(docs: DataFrame, cfg: SanitizeConfig = SanitizeConfig(), key: str = "doc_id") -> None:
    """Temporary views for SQL users: pii_findings, pii_summary, pii_sanitized."""
    engine = Engine(cfg)
    found = detect.findings_table(docs, cfg, key=key)
    found.createOrReplaceTempView("pii_findings")
    report.summary(found, key).createOrReplaceTempView("pii_summary")
    engine.sanitize(docs, key=key).select(key, "sanitized").createOrReplaceTempView("pii_sanitized")


def register_sql_functions(spark: SparkSession) -> None:
    """SQL forms of the expressions as temporary functions, all of them native."""
    spark.sql("DROP TEMPORARY FUNCTION IF EXISTS mask_text")
    spark.sql(f"CREATE TEMPORARY FUNCTION mask_text(entity STRING, original STRING, style STRING) RETURNS STRING RETURN CASE WHEN style = 'black' THEN repeat('{fixed.BLOCK}', length(original)) ELSE concat('[', entity, ']') END")
    spark.sql("DROP TEMPORARY FUNCTION IF EXISTS nif_letter")
    spark.sql(f"CREATE TEMPORARY FUNCTION nif_letter(number BIGINT) RETURNS STRING RETURN substring('{fixed.NIF_LETTERS}', CAST(number % 23 AS INT) + 1, 1)")

