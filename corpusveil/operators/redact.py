"""Redaction of texts and cells, and the decision tables of the pixel sanitizers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.expr import first_at, replace_last


def is_redacted(entity_type: Column, entities: tuple[str, ...] | None) -> Column:
    """Without a selection everything is redacted."""
    return entity_type.isin(*entities) if entities else F.lit(True)


def replacement(entity_type: Column, original: Column, style: str) -> Column:
    """[TYPE] for placeholder and blur; a block per code point for black."""
    if style == "black":
        return F.repeat(F.lit(fixed.BLOCK), F.length(original))
    return F.concat(F.lit("["), entity_type, F.lit("]"))


def redact_text(text: Column, findings: Column, style: str = "black", ordered: bool = True) -> Column:
    """One replacement per finding, each of the last occurrence left, from the right: findings
    are taken by falling place of their first occurrence, those that do not occur first.
    ordered=False takes them as they come. Findings with null or empty text are skipped."""
    usable = F.filter(findings, lambda f: F.coalesce(F.length(f.original_text) > 0, F.lit(False)))
    if ordered:
        place = lambda f: F.when(F.contains(text, f.original_text), first_at(text, f.original_text)).otherwise(F.length(text))
        ranked = F.transform(usable, lambda f, i: F.struct((-place(f)).alias("p"), i.alias("i"), f.alias("f")))
        usable = F.transform(F.sort_array(ranked), lambda r: r.f)
    return F.aggregate(usable, text, lambda t, f: replace_last(t, f.original_text, replacement(f.entity_type, f.original_text, style)))


def redact_offsets(text: Column, findings: Column, style: str = "black") -> Column:
    """The same for findings with start and end, cut once by offset: linear in the text. Of
    overlapping findings the first by start, then the longer one, is replaced."""
    ordered = F.sort_array(F.transform(findings, lambda f: F.struct(f.start.alias("start"), (-f.end).alias("back"), f.entity_type.alias("entity_type"), f.original_text.alias("original_text"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, f: Column) -> Column:
        more = F.array(F.substring(text, a.at + 1, f.start - a.at), replacement(f.entity_type, f.original_text, style))
        return F.when(f.start >= a.at, F.struct((-f.back).alias("at"), F.concat(a.out, more).alias("out"))).otherwise(a)

    return F.aggregate(ordered, start, step, lambda a: F.concat(F.array_join(a.out, ""), F.substring(text, a.at + 1, F.length(text))))


def redact_cell(cell: Column, findings: Column, style: str = "black") -> Column:
    """Every occurrence of every finding, in order."""
    usable = F.filter(findings, lambda f: F.coalesce(F.length(f.original_text) > 0, F.lit(False)))
    return F.aggregate(usable, cell, lambda c, f: F.replace(c, f.original_text, replacement(f.entity_type, f.original_text, style)))


def redact_table(df: DataFrame, findings: Column, columns: list[str], style: str = "black") -> DataFrame:
    """A table with the named string columns redacted cell by cell."""
    return df.withColumns({c: redact_cell(F.col(c), findings, style) for c in columns})


def output_filename(filename: Column) -> Column:
    """stem_sanitized.suffix of the last path part; only the last suffix counts, and a leading
    dot begins a stem."""
    base = F.regexp_extract(filename, r"([^/]*)/*$", 1)
    stem, suffix = F.regexp_extract(base, r"^(.+?)(\.[^.]+)?$", 1), F.regexp_extract(base, r"^.+?(\.[^.]+)$", 1)
    return F.concat(stem, F.lit("_sanitized"), suffix)


def pdf_action(page: Column, has_bbox: Column, pages: Column, entity_type: Column, style: str) -> Column:
    """skip, black or label: what is drawn over a finding of a page document."""
    visual = entity_type.isin("FACE", "SIGNATURE")
    drawn = F.when(visual, "black").otherwise("label") if style == "placeholder" else F.lit("black")
    return F.when(page.isNull() | ~has_bbox | (page < 0) | (page >= pages), "skip").otherwise(drawn)


def image_action(has_bbox: Column, width: Column, height: Column, entity_type: Column, style: str) -> Column:
    """skip, black, blur or label; regions under 10 by 10 are too small to blur."""
    if style == "blur":
        drawn = F.when((width >= 10) & (height >= 10), "blur").otherwise("black")
    elif style == "placeholder":
        drawn = F.when(entity_type.isin("FACE", "SIGNATURE"), "black").otherwise("label")
    else:
        drawn = F.lit("black")
    return F.when(~has_bbox, "skip").otherwise(drawn)


def label_scale(width: Column, label: Column) -> Column:
    """Font scale of a label: a fifteenth of the width per letter, between 0.3 and 1.5."""
    return F.greatest(F.lit(0.3), F.least(width / (F.length(label) * 15), F.lit(1.5)))
