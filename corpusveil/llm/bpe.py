"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is cut by the vocabulary's pattern; each piece is merged on its own. A piece's bytes
form a linked list; every mergeable pair waits in the bucket of its rank, and a two-level
bitmap over ranks gives the lowest filled bucket by find-first-set. Entries that no longer
hold when they come up are skipped, so a merge costs a constant number of steps and a piece
of a million bytes is as safe as a short one. The leftmost pair of the lowest rank goes first,
as in the reference encoders.

Defined cases: a null text counts as empty and gives no ids; special-token strings are
ordinary text; ids are whole little-endian unsigned 32-bit integers; decoding ids outside the
vocabulary raises KeyError naming the id. Rows are coded one by one, so ties, repeated rows and
empty tables need no rule; other columns are not read.

Scale: one pass, no shuffle. The vocabulary is broadcast: its size is that of a fixed file
(under 2 MB). Pieces already merged are remembered per worker, in two stores of at most CACHE
pieces of at most CACHED_CHARS characters.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from .common import text_of

CACHE, CACHED_CHARS = 250_000, 64
#: Words of the bitmap hold 256 ranks.
SHIFT, MASK = 8, 255
SINGLES = tuple(bytes([c]) for c in range(256))
ROWS_OUT = 256

#: The same cuts for texts that are ASCII only, where \p{L} is A-Za-z and \p{N} is 0-9.
ASCII_FORM = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Coder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.ids = {k: v.to_bytes(4, "little") for k, v in ranks.items()}
        self.tokens = {v: k for k, v in ranks.items()}
        self.cut = regex.compile(pattern).findall
        self.cut_ascii = ascii_cut(pattern)
        #: Merged pieces by age: the old store goes when the new one is full, so that pieces in
        #: use move on and rare ones leave.
        self.seen: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: The queue's parts, empty again after every piece.
        self.buckets: dict[int, list[int]] = {}
        self.words = [0] * ((max(ranks.values(), default=0) >> SHIFT) + 1)

    def merge(self, piece: bytes) -> bytes:
        """The ids of one piece."""
        ranks, ids = self.ranks, self.ids
        if (whole := ids.get(piece)) is not None:
            return whole
        n, get = len(piece), ranks.get
        # The queue: positions by rank, filled ranks by word, filled words. One lookup a step;
        # its methods are written out here because calls would double the cost of a merge.
        buckets, words, top = self.buckets, self.words, 0
        part = [SINGLES[c] for c in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at = [get(a + b, -1) for a, b in zip(part, part[1:], strict=False)]
        rank_at.append(-1)
        i = 0
        for rank in rank_at:
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(i)  # rising positions are a heap
                else:
                    buckets[rank] = [i]
                    word = rank >> SHIFT
                    words[word] |= 1 << (rank & MASK)
                    top |= 1 << word
            i += 1
        while top:
            word = (top & -top).bit_length() - 1
            held = words[word]
            low = held & -held
            rank = (word << SHIFT) + low.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                words[word] = held = held ^ low
                if not held:
                    top &= top - 1
            if rank_at[i] != rank:
                continue  # stale: this pair has changed or gone
            j = after[i]
            merged = part[i] = part[i] + part[j]
            rank_at[j] = -1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                rank_at[i] = rank = get(merged + part[j], -1)
                if rank >= 0:
                    if rank in buckets:
                        heappush(buckets[rank], i)
                    else:
                        buckets[rank] = [i]
                        word = rank >> SHIFT
                        words[word] |= 1 << (rank & MASK)
                        top |= 1 << word
            else:
                rank_at[i] = -1
            j = before[i]
            if j >= 0:
                rank_at[j] = rank = get(part[j] + merged, -1)
                if rank >= 0:
                    if rank in buckets:
                        heappush(buckets[rank], j)
                    else:
                        buckets[rank] = [j]
                        word = rank >> SHIFT
                        words[word] |= 1 << (rank & MASK)
                        top |= 1 << word
        out, i = [], 0
        while i < n:
            out.append(ids[part[i]])
            i = after[i]
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        pieces = (self.cut_ascii if text.isascii() else self.cut)(text)
        seen, out = self.seen, []
        add, get = out.append, seen.get
        for piece in pieces:
            ids = get(piece)
            if ids is None:
                ids = self.old.get(piece)
                if ids is None:
                    ids = self.merge(piece.encode())
                if len(piece) <= CACHED_CHARS:
                    if len(seen) >= CACHE:
                        self.old, self.seen = seen, {}
                        seen, get = self.seen, self.seen.get
                    seen[piece] = ids
            add(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in memoryview(ids).cast("I")])


def ascii_cut(pattern: str):
    """findall of the same pattern in the faster re module, good for ASCII texts only."""
    inside = re.sub(r"\[\^?[^\]]*\]", lambda m: _spelled(m[0], "{}"), pattern)
    return re.compile(_spelled(inside, "[{}]"), re.ASCII).findall


def _spelled(part: str, form: str) -> str:
    for name, letters in ASCII_FORM.items():
        part = part.replace(name, form.format(letters))
    return part


_CODER: dict[tuple, Coder] = {}


def coder(vocabulary: Broadcast, pattern: str) -> Coder:
    """The worker's own coder, built once."""
    key = (vocabulary.value["key"], pattern)
    if key not in _CODER:
        _CODER.clear()
        _CODER[key] = Coder(vocabulary.value["ranks"], pattern)
    return _CODER[key]


def _share(docs: DataFrame, path: str) -> Broadcast:
    ranks = load_ranks(path)
    return docs.sparkSession.sparkContext.broadcast({"key": path, "ranks": ranks})


def code(docs: DataFrame, path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id", more: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, ids (binary, little-endian uint32), decoded (binary), and the
    columns of `more`."""
    ship(docs.sparkSession)
    vocabulary = _share(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary, pattern)
        for b in batches:
            for at in range(0, b.num_rows, ROWS_OUT):
                part = b.slice(at, ROWS_OUT)
                ids = [own.encode(t.as_py().decode("utf-8", "replace")) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([own.decode(i) for i in ids], pa.binary()), *part.columns[2:]], names=["doc_id", "ids", "decoded", *more])

    typed = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).cast("binary").alias("text"), *more)
    kinds = "".join(f", `{c}` {typed.schema[c].dataType.simpleString()}" for c in more)
    return typed.mapInArrow(run, f"doc_id {typed.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary{kinds}")


def digest(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, digests of ids and text, and what else `code` was given."""
    more = [c for c in coded.columns if c not in ("doc_id", "ids", "decoded")]
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *more)
