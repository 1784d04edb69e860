"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1 (straight lines between equally
spaced knots). The area under it up to t is the share of the source's tokens due by t; the
inverse of that area gives each document its training position from the tokens of its source
that come before it. Documents are then range-sorted by position.

Targets: sources in code-point order of their name, null last, weigh `weights` in turn and
share all words; a target stops at `max_repeats` times its source's size and the excess goes
to the others by weight until none is above. That fixed point is found in one pass: a source
is full exactly if its capacity per weight lies below the level the rest would get.

Within a source the documents follow the MD5 of their id, so reruns agree; a source whose
target exceeds its size is walked again from the start, at most `max_repeats` times. A copy
is taken when its middle lies at or before the target, so a source misses its target by half
a document at most.

Defined cases: a null or blank text has size 0 and takes no words; a null source is a source
of its own; null or repeated ids order as the empty string, or among themselves by size and text; an
empty table gives an empty result. `mix` reads no other columns, `curriculum_order` keeps all.

Scale: running sums are two-level. Documents fall into 16**digits buckets per source by the
first hex digits of the MD5; bucket sums are combined map-side and prefix-summed over at most
that many rows a source; inside a bucket a window sorts its own rows only. A source with a
third of all rows is therefore spread over all buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, text_of

#: Knots of the default curriculum by weight class: light sources early, heavy ones late.
CURRICULUM = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def sizes(docs: DataFrame, digits: int, keep: Sequence[str] = ()) -> DataFrame:
    rank = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select(
        "doc_id",
        "source",
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        F.col("source").isNull().alias("_sn"),
        F.coalesce("source", F.lit("")).alias("_sv"),
        rank.alias("_rank"),
        F.xxhash64(text_of()).alias("_text"),
        *[F.col(c).alias(f"_keep_{c}") for c in keep],
    ).withColumn("_bucket", F.substring("_rank", 1, digits))


def targets(buckets: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """One row per source: _sn, _sv, source_size, _class, target. Its windows without a key run
    over one row a source in one task, some 100 bytes each: good for millions of sources."""
    by_name = Window.orderBy("_sn", F.col("_sv"))
    sources = buckets.groupBy("_sn", "_sv").agg(F.sum("_words").alias("source_size")).withColumn("_class", (F.row_number().over(by_name) - 1) % len(weights))
    sources = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), F.col("_class") + 1).cast("long")).withColumn("_cap", F.col("source_size") * max_repeats)
    every = Window.partitionBy()
    by_need = Window.orderBy(F.col("_cap") / F.col("_w"), "_sn", "_sv").rowsBetween(Window.unboundedPreceding, -1)
    total, weight = F.sum("source_size").over(every), F.sum("_w").over(every)
    filled, used = F.coalesce(F.sum("_cap").over(by_need), F.lit(0)), F.coalesce(F.sum("_w").over(by_need), F.lit(0))
    # Before this source in order of capacity per weight, all are full if it is full itself.
    level = sources.select("*", (total - filled).alias("_left"), (weight - used).alias("_open")).withColumn("_full", F.col("_cap") * F.col("_open") < F.col("_w") * F.col("_left"))
    free = F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_w"))).over(every)
    due = total - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0)).over(every)
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(due.cast("double") * F.col("_w") / free)
    return level.select("_sn", "_sv", "source_size", "_class", target.alias("target"))


def invert(share: Column, knots: Column) -> Column:
    """The time at which the area under a schedule through `knots` reaches `share` of it."""
    n = F.size(knots) - 1
    step = F.lit(1.0) / n
    trapezium = lambda i: (F.get(knots, i) + F.get(knots, i + 1)) / 2 * step
    whole = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, i: a + trapezium(i))
    start = F.struct((share * whole).alias("rest"), F.lit(-1.0).alias("at"))

    def walk(a: Column, i: Column) -> Column:
        area, w0 = trapezium(i), F.get(knots, i)
        slope = (F.get(knots, i + 1) - w0) / step
        root = w0 + F.sqrt(F.greatest(w0 * w0 + 2 * slope * a.rest, F.lit(0.0)))
        inside = F.when(root > 0, 2 * a.rest / root).otherwise(0.0)
        here = (a.at < 0) & ((a.rest <= area) | (i == n - 1))
        return F.struct(F.when(a.at >= 0, a.rest).otherwise(a.rest - area).alias("rest"), F.when(here, i * step + F.least(inside, step)).otherwise(a.at).alias("at"))

    return F.aggregate(F.sequence(F.lit(0), n - 1), start, walk, lambda a: a.at)


def _placed(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3, curriculum: Sequence[Sequence[float]] = CURRICULUM, digits: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """The columns of `mix` in no order, and those of `keep` under the prefix _keep_."""
    sized = sizes(docs, digits, keep)
    narrow = durable(sized, "mix-sizes") if not keep else sized
    key = ["_sn", "_sv", "_bucket"]
    sums = durable(narrow.groupBy(*key).agg(F.sum("size").alias("_words")), "mix-buckets")
    before = Window.partitionBy("_sn", "_sv").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = targets(sums, weights, max_repeats)
    knots = F.get(F.array(*[F.array(*map(F.lit, k)) for k in curriculum]), F.col("_class") % len(curriculum))
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_words").over(before), F.lit(0))).join(plan, ["_sn", "_sv"]).withColumn("_knots", knots).drop("_words", "_class")
    inside = Window.partitionBy(*key).orderBy("_rank", "doc_id", "size", "_text").rowsBetween(Window.unboundedPreceding, -1)
    placed = narrow.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, key)
    middle = lambda e: F.col("_offset") + F.col("_in") + e * F.col("source_size") + F.col("size") / 2
    epochs = F.filter(F.array(*[F.lit(e).cast("long") for e in range(max_repeats)]), lambda e: (F.col("size") > 0) & (middle(e) <= F.col("target")))
    at = F.transform(epochs, lambda e: invert(middle(e) / F.col("target"), F.col("_knots")))
    return placed.withColumn("positions", at).select("doc_id", "source", "size", "source_size", "target", "positions", (F.size("positions") * F.col("size")).cast("long").alias("taken"), "_text", *[f"_keep_{c}" for c in keep])


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document, range-sorted by its first position (documents that the mix leaves
    out come last): doc_id, source, size, source_size, target, positions (array<double>, one
    training position per copy taken), taken. options: weights, max_repeats, curriculum, digits."""
    order = (F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0)), F.col("doc_id"), F.col("_text"))
    return _placed(docs, **options).repartitionByRange(*order).sortWithinPartitions(*order).drop("_text")


def curriculum_order(docs: DataFrame, position_col: str = "position", **options) -> DataFrame:
    """The training order itself: the documents' own columns plus a position, one row per copy
    taken, range-sorted by position. A column already named like the position is replaced."""
    names = [c for c in docs.columns if c != position_col]
    copies = _placed(docs, keep=names, **options).select(*[F.col(f"_keep_{c}").alias(c) for c in names], F.explode("positions").alias(position_col), F.col("_text").alias("__text"))
    order = (F.col(position_col), F.col("doc_id"), F.col("__text"))
    return copies.repartitionByRange(*order).sortWithinPartitions(*order).drop("__text")
