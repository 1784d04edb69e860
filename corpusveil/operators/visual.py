"""The arithmetic of visual detection over component tables; pixels are a provider's business."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signature_candidates(components: DataFrame) -> DataFrame:
    """components (left, top, width, height, area, img_width, img_height) that look like a
    signature, with their score. Bounds and weights are fixed values."""
    box = F.col("width") * F.col("height")
    ratio, aspect, density = F.col("area") / (F.col("img_width") * F.col("img_height")), F.col("width") / F.col("height"), F.col("area") / box
    fits = (F.col("width") > 0) & (F.col("height") > 0) & ratio.between(0.001, 0.15) & aspect.between(1.5, 8.0) & density.between(0.02, 0.35)
    shape = 1 - F.least(F.abs(aspect - 3) / 3, F.lit(1.0))
    ink = 1 - F.least(F.abs(density - 0.15) / 0.20, F.lit(1.0))
    score = F.greatest(F.lit(0.4), F.least(0.4 + 0.2 * (0.5 * shape + 0.5 * ink), F.lit(0.6)))
    return components.filter(fits).withColumn("score", F.round(score, 2))


def translated(df: DataFrame) -> DataFrame:
    """Boxes inside an embedded image moved by the image's origin on its page; not scaled."""
    return df.withColumns({c: F.col(c) + F.col(o) for c, o in (("x0", "origin_x"), ("y0", "origin_y"), ("x1", "origin_x"), ("y1", "origin_y"))})


def ordered_corners(points: Column) -> Column:
    """Four points (x, y) as top left, top right, bottom right, bottom left: smallest and largest
    x + y, smallest and largest y - x."""
    by = lambda f, largest: F.get(F.sort_array(F.transform(points, lambda p: F.struct(f(p).alias("k"), p.alias("p"))), not largest), F.lit(0)).p
    total, slope = (lambda p: p.x + p.y), (lambda p: p.y - p.x)
    return F.array(by(total, False), by(slope, False), by(total, True), by(slope, True))


def faces(predictions: DataFrame, score: float = 0.4) -> DataFrame:
    """Face boxes (x, y, w, h, score) of a provider as findings."""
    kept = predictions.filter(F.col("score") >= score)
    return kept.select(*[c for c in predictions.columns if c not in ("x", "y", "w", "h", "score")], F.lit("FACE").alias("entity_type"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"), "score")
