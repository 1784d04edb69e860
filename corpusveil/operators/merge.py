"""Merging findings of an optional named-entity layer into the pattern findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.expr import let

LAYER = "array<struct<entity_type:string,original_text:string,score:double>>"


def label_type(label: Column) -> Column:
    """Finding type of a model's label, whatever its case; unknown labels are sensitive data."""
    table = F.create_map(*[F.lit(x) for kv in fixed.LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(label)), F.lit("SENSITIVE_DATA"))


def layer_findings(predictions: Column, threshold: float = 0.5) -> Column:
    """array<struct<label, text, score>> of a model as findings, scores rounded half-even."""
    sure = F.filter(predictions, lambda p: p.score >= threshold)
    return F.transform(sure, lambda p: F.struct(label_type(p.label).alias("entity_type"), p.text.alias("original_text"), F.bround(p.score, 2).alias("score")))


def same_text(a: Column, b: Column) -> Column:
    """Equal, or one inside the other, in lower case without outer blanks; never for empty."""
    x, y = F.lower(F.btrim(a)), F.lower(F.btrim(b))
    return F.coalesce((F.length(a) > 0) & (F.length(b) > 0) & (x.contains(y) | y.contains(x)), F.lit(False))


def merge(existing: Column, new: Column) -> Column:
    """Folds new findings into existing ones, in order: the first duplicate in the list so far
    is replaced if the new score is higher, else the new one is dropped; others are appended.
    The entity type plays no part, and a null text is always appended."""

    def step(merged: Column, f: Column) -> Column:
        places = F.filter(F.transform(merged, lambda m, i: F.when(same_text(m.original_text, f.original_text), i).otherwise(-1)), lambda i: i >= 0)

        def put(at: Column) -> Column:
            swapped = F.transform(merged, lambda m, i: F.when((i == at) & (f.score > m.score), f).otherwise(m))
            return F.when(at.isNull(), F.concat(merged, F.array(f))).otherwise(swapped)

        return let(F.get(places, F.lit(0)), put)

    return F.aggregate(new, existing.cast(LAYER), step)


def with_layer(df: DataFrame, predictions: str = "predictions", threshold: float = 0.5) -> DataFrame:
    """findings (type, text, score) merged with a column of model predictions; a null column
    (model missing or failed) leaves them as they are."""
    base = F.transform("findings", lambda f: F.struct(f.entity_type.alias("entity_type"), f.original_text.alias("original_text"), f.score.alias("score")))
    return df.withColumn("merged", F.when(F.col(predictions).isNull(), base).otherwise(merge(base, layer_findings(F.col(predictions), threshold))))
