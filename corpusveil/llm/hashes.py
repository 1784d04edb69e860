"""Hashes of words and of runs of words for whole batches of texts, in numpy.

A word's hash is a polynomial of its bytes modulo 2**64, mixed; A-Z count as a-z, and words are
cut by the word rule's white space, so bytes do. A run's hash is a polynomial of its words' hashes.
Both are differences of one running sum, moved to a common power, so a batch needs no loop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts that are hashed at once.
TOGETHER = 1_000_000
BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * BASE % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(12, n.bit_length())
        _POWERS[:] = [np.cumprod(np.where(np.arange(size) == 0, np.uint64(1), np.uint64(b)), dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS


def between(items: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the items of each range."""
    up, down = powers(len(items) + 1)
    sums = np.zeros(len(items) + 1, np.uint64)
    np.cumsum(items * up[: len(items)], dtype=np.uint64, out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def runs_of(items: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` hashed items."""
    starts = np.arange(max(0, len(items) - width + 1))
    return mixed(between(items, starts, starts + width), width)


#: A number for each byte, the same for A-Z and a-z; and which bytes are white space.
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64), 1)
_BYTES[65:91] = _BYTES[97:123]
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


def hashed_words(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of some texts of a binary column at a time: the hashes of all their words, and where each
    text's begin (and the last one's end)."""
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + TOGETHER, side="right")) - 1)
        part, cuts = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        word = ~_BLANK[part]
        # Changes between blank and word; a text's end ends its word too.
        change = np.zeros(len(part) + 1, bool)
        change[1:-1] = word[1:] != word[:-1]
        change[cuts] = True
        edges = np.nonzero(change)[0]
        starts = word[edges[:-1]]
        starts, ends = edges[:-1][starts], edges[1:][starts]
        yield mixed(between(_BYTES[part], starts, ends), 0), np.searchsorted(starts, cuts)
        lo = hi
