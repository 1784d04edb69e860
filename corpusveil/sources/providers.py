"""Capabilities that need a model or a codec: page layout, OCR, named entities, faces.

A provider is registered by name; asking for one that is not there raises, so a plan fails
when it is built and not in the middle of a job.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame


class SpanProvider(Protocol):
    """Pages or images to placed spans: doc_id, seq, sep, text, page, x0, y0, x1, y1."""

    def spans(self, files: DataFrame) -> DataFrame: ...


class EntityProvider(Protocol):
    """Adds predictions: array<struct<label, text, score>>, null where the model failed."""

    def predict(self, documents: DataFrame, labels: tuple[str, ...]) -> DataFrame: ...


class RegionProvider(Protocol):
    """Images to boxes with scores: faces (x, y, w, h, score), or ink components."""

    def regions(self, images: DataFrame) -> DataFrame: ...


class PixelProvider(Protocol):
    """Applies decided actions (skip, black, blur, label) to pages or images."""

    def draw(self, files: DataFrame, actions: DataFrame) -> DataFrame: ...


KINDS = ("pdf", "ocr", "ner", "face", "components", "image_preprocessing", "draw")
_REGISTERED: dict[str, object] = {}


def register(kind: str, provider: object) -> None:
    if kind not in KINDS:
        raise ValueError(f"Unknown provider kind '{kind}'. Known: {', '.join(KINDS)}")
    _REGISTERED[kind] = provider


def unregister(kind: str) -> None:
    _REGISTERED.pop(kind, None)


def available(kind: str) -> bool:
    return kind in _REGISTERED


def provider(kind: str):
    if kind not in _REGISTERED:
        raise RuntimeError(f"A '{kind}' provider is required for {kind} support")
    return _REGISTERED[kind]
