"""What visual detection and redaction do to pixels, in numpy over Arrow batches of images.

Ink components: adaptive threshold against a Gaussian mean, closing, 8-connected labelling by
runs. Images are bounded by the size gate; one is held at a time. A file that cannot be read
gives an error row, never a failed task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from ..sources import parsers, png
from . import visual

#: Size of the threshold's neighbourhood and how much darker ink is; reach of the closing.
BLOCK_SIZE, DARKER = 15, 10
CLOSE_X, CLOSE_Y = 9, 5


def _smooth(values: np.ndarray, axis: int) -> np.ndarray:
    """A Gaussian mean of BLOCK_SIZE along an axis, BLOCK_SIZE - 1 shorter than the values."""
    half = BLOCK_SIZE // 2
    sigma = 0.3 * ((BLOCK_SIZE - 1) * 0.5 - 1) + 0.8
    weights = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * sigma**2))
    n = values.shape[axis] - BLOCK_SIZE + 1
    part = lambda k: values[:, k : k + n] if axis else values[k : k + n]
    out = np.zeros_like(part(0))
    for k, w in enumerate(weights / weights.sum()):
        out += w * part(k)
    return out


def _reduced(values: np.ndarray, size: int, axis: int, by: np.ufunc) -> np.ndarray:
    """`by` over each run of `size` along an axis, size - 1 shorter than the values."""
    part = lambda x, k, n: x[:, k : k + n] if axis else x[k : k + n]
    n, width = values.shape[axis], 1
    while width < size:
        step = min(width, size - width)
        n -= step
        values, width = by(part(values, 0, n), part(values, step, n)), width + step
    return values


def ink(grey: np.ndarray) -> np.ndarray:
    """Pixels darker than their neighbourhood by DARKER at least; the border goes on as it is. No
    mean is above its largest pixel, so it is taken only in the bands of rows where that one is
    lighter by as much."""
    wide = np.pad(grey, BLOCK_SIZE // 2, mode="edge")
    most = _reduced(_reduced(wide, BLOCK_SIZE, 1, np.maximum), BLOCK_SIZE, 0, np.maximum)
    some = most - grey >= DARKER
    out = np.zeros(grey.shape, bool)
    rows, columns = (np.flatnonzero(some.any(axis)) for axis in (1, 0))
    if len(rows):
        x0, x1 = columns[0], columns[-1] + 1
        # Bands whose neighbourhoods overlap are one.
        for band in np.split(rows, np.flatnonzero(np.diff(rows) >= BLOCK_SIZE) + 1):
            y0, y1 = band[0], band[-1] + 1
            mean = np.rint(_smooth(_smooth(wide[y0 : y1 + BLOCK_SIZE - 1, x0 : x1 + BLOCK_SIZE - 1].astype(np.float64), 1), 0))
            out[y0:y1, x0:x1] = grey[y0:y1, x0:x1] <= mean - DARKER
    return out


def _reached(mask: np.ndarray) -> np.ndarray:
    """Whether any pixel of CLOSE_X by CLOSE_Y around is set; nothing beyond the border is."""
    wide = np.pad(mask, [(CLOSE_Y // 2,) * 2, (CLOSE_X // 2,) * 2])
    return _reduced(_reduced(wide, CLOSE_X, 1, np.logical_or), CLOSE_Y, 0, np.logical_or)


def closed(mask: np.ndarray) -> np.ndarray:
    return ~_reached(~_reached(mask))


def components(mask: np.ndarray) -> np.ndarray:
    """left, top, width, height, area of each 8-connected component, by first row and column."""
    height, width = mask.shape
    wide = np.zeros((height, width + 2), np.int8)
    wide[:, 1:-1] = mask
    change = np.diff(wide, axis=1)
    row, start = np.nonzero(change == 1)
    end = np.nonzero(change == -1)[1]  # exclusive; the runs of each row alternate, so they line up
    # The runs of the row above that touch, corners too, are neighbours: runs lie in the order of their starts and ends.
    line = row * (width + 2)
    lo = np.searchsorted(line + end, line - (width + 2) + start, "left")
    met = np.maximum(np.searchsorted(line + start, line - (width + 2) + end, "right") - lo, 0)
    below = np.repeat(np.arange(len(row)), met)
    above = np.arange(len(below)) - np.repeat(np.cumsum(met) - met, met) + lo[below]
    up = list(range(len(row)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in zip(above.tolist(), below.tolist(), strict=True):
        x, z = root(a), root(b)
        if x != z:
            up[max(x, z)] = min(x, z)
    roots, of = np.unique([root(i) for i in range(len(row))], return_inverse=True)
    out = np.zeros((len(roots), 5), np.int64)
    if len(roots):
        left, top, right, bottom = (np.full(len(roots), v) for v in (width, height, 0, 0))
        for extreme, to, values in ((np.minimum, left, start), (np.minimum, top, row), (np.maximum, right, end), (np.maximum, bottom, row + 1)):
            extreme.at(to, of, values)
        out = np.stack([left, top, right - left, bottom - top, np.bincount(of, end - start, len(roots)).astype(np.int64)], axis=1)
    return out


def _grey_of(content: bytes) -> np.ndarray:
    return png.grey(png.decode(content))


def ink_components(images: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """images: keys and content (PNG). keys, left, top, width, height, area, img_width, img_height;
    one row with an error instead for a file that cannot be read."""
    names = ("left", "top", "width", "height", "area", "img_width", "img_height")
    kind = ", ".join(f"`{k}` {images.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, content in enumerate(b.column(len(keys)).to_pylist()):
                try:
                    grey = _grey_of(content)
                    found = [[*map(int, x), grey.shape[1], grey.shape[0], None] for x in components(closed(ink(grey)))]
                except parsers.UNREADABLE as e:
                    found = [[*[None] * len(names), str(e) or type(e).__name__]]
                cells = [[b.column(k)[i].as_py()] * len(found) for k in range(len(keys))] + [list(c) for c in zip(*found, strict=True)] if found else []
                if cells:
                    types = [b.schema.field(k).type for k in range(len(keys))] + [pa.float64()] * len(names) + [pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names=[*keys, *names, "error"])

    ship(images.sparkSession)
    return images.select(*keys, "content").mapInArrow(run, f"{kind}, " + ", ".join(f"{n} double" for n in names) + ", error string")


def signatures(images: DataFrame, level: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Findings of type SIGNATURE in images: keys, entity_type, x0, y0, x1, y1, score. At the strict
    level only; with columns origin_x and origin_y among the keys the boxes are moved by them."""
    found = visual.signature_candidates(ink_components(images, keys).filter("error IS NULL"))
    boxes = found.select(*keys, F.lit("SIGNATURE").alias("entity_type"), F.col("left").alias("x0"), F.col("top").alias("y0"), (F.col("left") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"), "score")
    boxes = visual.translated(boxes) if {"origin_x", "origin_y"} <= set(keys) else boxes
    return boxes if level == "strict" else boxes.filter("false")


def drawn(image: np.ndarray, boxes: list[dict]) -> np.ndarray:
    """The image with its boxes (x0, y0, x1, y1) filled with black."""
    out = image.copy()
    for box in boxes:
        x0, y0 = max(0, int(box["x0"])), max(0, int(box["y0"]))
        x1, y1 = int(np.ceil(box["x1"])), int(np.ceil(box["y1"]))
        out[y0 : max(y0, y1), x0 : max(x0, x1), : min(3, image.shape[2]) if image.shape[2] != 2 else 1] = 0
    return out


def blacked(images: DataFrame, boxes: Column) -> DataFrame:
    """images (content: PNG, ...) plus sanitized (PNG with the boxes filled) and sanitize_error."""

    def one(content: bytes, found: list[dict] | None) -> tuple:
        try:
            return (png.encode(drawn(png.decode(content), found)) if found else content), None
        except parsers.UNREADABLE as e:
            return None, str(e) or type(e).__name__

    made = parsers._with(images.withColumn("__boxes", boxes), pa.schema([("sanitized", pa.binary()), ("sanitize_error", pa.string())]), one, ("content", "__boxes"))
    return made.drop("__boxes")
