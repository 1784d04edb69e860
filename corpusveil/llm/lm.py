r"""Interpolated modified Kneser-Ney language model for perplexity, of order three by default.

Counting: tasks turn texts into 64-bit word hashes, sort and count triples (a, b, c) a few million
tokens at a time, and send one block per shard of the middle word b. A shard then holds all of a
context (a, b), all preceding words of a pair (b, c) and all followers of b, so it writes its part of
the model at once: sorted hash arrays of contexts, of their followers, of pairs and of words as
contexts. Triples of hot middle words (those with more than half a shard's share in a bounded sample,
and at most `hot` of them) are dealt by (a, b) instead; their pairs, and those of the start mark, meet
in a second exchange, where the preceding words add up. The list only steers. A last exchange by word
gives raw and continuation counts. With `order` two there are no triples and pairs carry raw counts.

Files lie in the shared folder and are mapped into memory by the scoring workers. A key is kept as 32
bits under an index of buckets of about eight keys, a follower as 32 bits inside its context: a lookup
of an absent key is wrong with a probability of about 2e-9. Files are written under a temporary name
and renamed, so a repeated task replaces them with the same bytes.

Model: p(c|ab) = max(n(abc) - D3, 0) / n(ab.) + g(ab) p(c|b); the lower levels do the same with the
number of different words before (b, c) and before c; the last one is mixed with a uniform 1 / (V + 1),
V + 1 counting one unknown word. Nothing comes before the start mark, so pairs with it keep their raw
counts, and the first token is scored by its pair. D has the usual three values per level from the
counts of counts. Tokens: A-Z in lower case, words by the word rule, then one end, counted as a token.

Defined cases: a null or blank text is one end token; a null id counts as the empty string
for the split; repeated rows are counted and scored each; with no training rows every token
gets the uniform probability; an empty table gives an empty result. Other columns are not read.

Scale: the number of shards follows the bytes of text (`bytes_per_shard`) without a ceiling, so one
shard's arrays fit a worker. Counting runs in `slices` of the shards, one after the other, each over
all texts: only one slice's blocks are on disk at a time. Mapped pages belong to the page cache.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from .common import SPACE_CLASS, durable, new_path, text_of
from .hashes import hashed_words

#: Stand for the end and the start; any two numbers, as far as words are hashed.
END, START = 0x5851F42D4C957F2D, 0xDA3E39CB94B95BDB
FLUSH = 3_000_000
LOOKUP = 1_000_000
#: Contexts with more followers keep their sums in the file.
FEW = 6


def tokens(texts: pa.Array) -> Iterator[np.ndarray]:
    """Hashes of the words and the end, of each text of a binary column."""
    for words, cuts in hashed_words(texts):
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield np.append(words[a:b], np.uint64(END))


def before(words: np.ndarray) -> np.ndarray:
    out = np.empty_like(words)
    out[0], out[1:] = START, words[:-1]
    return out


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = first * np.uint64(0x9E3779B97F4A7C15) + second
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def spread(key: np.ndarray) -> np.ndarray:
    """Another hash of a hash, whose high bits do not follow the shard."""
    x = (key ^ (key >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shard_of(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.int64)


def member(sorted_keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(asked), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, asked), len(sorted_keys) - 1)] == asked


def runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    n = len(sorted_columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return np.nonzero(new)[0]


def ranges(cuts: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    return zip(cuts, np.append(cuts, n)[1:], strict=False)


def summed(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values.astype(np.int64), heads) if len(heads) else np.empty(0, np.int64)


def kinds(values: np.ndarray, heads: np.ndarray) -> list[np.ndarray]:
    """Per run: the sum, and how many values are one, two, and three or more."""
    return [summed(values, heads), *[summed(hit, heads) for hit in (values == 1, values == 2, values > 2)]]


def of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


# --- files of arrays in the shared folder -------------------------------------------------


def put_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    fs, path = pfs.FileSystem.from_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    head = ";".join(f"{k},{a.dtype.str},{len(a)}" for k, a in arrays.items()).encode()
    with fs.open_output_stream(draft) as out:
        out.write(head.ljust(1024))
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes())
            out.write(b"\0" * (-a.nbytes % 8))
    fs.move(draft, path)


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """Maps a file into memory; one in a remote store is copied to this worker first, and the
    copy's name is gone at once (the map keeps it open)."""
    fs, path = pfs.FileSystem.from_uri(uri)
    with tempfile.TemporaryDirectory() as near:
        if not isinstance(fs, pfs.LocalFileSystem):
            pfs.copy_files(path, os.path.join(near, "arrays"), source_filesystem=fs, destination_filesystem=pfs.LocalFileSystem())
            path = os.path.join(near, "arrays")
        whole, at, out = np.memmap(path, np.uint8, "r"), 1024, {}
    for part in whole[:1024].tobytes().decode().strip().split(";"):
        name, kind, n = part.split(",")
        size = int(n) * np.dtype(kind).itemsize
        out[name] = whole[at : at + size].view(np.ndarray).view(kind)
        at += size + -size % 8
    return out


def packed(name: str, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes; those of 255 or more apart."""
    over = np.nonzero(counts >= 255)[0]
    return {name: np.minimum(counts, 255).astype(np.uint8), f"{name}_at": over.astype(np.uint32), f"{name}_over": counts[over].astype(np.int64)}


def unpacked(arrays: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    out = arrays[name][at].astype(np.int64)
    over = np.nonzero(out == 255)[0]
    if len(over):
        out[over] = arrays[f"{name}_over"][np.searchsorted(arrays[f"{name}_at"], at[over])]
    return out


def hashed(name: str, keys: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted keys as an index of buckets by their first bits and the 32 bits after these."""
    bits = max(1, (len(keys) // 8).bit_length())
    index = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return {name: (keys >> np.uint64(32 - bits)).astype(np.uint32), f"{name}_index": index.astype(np.uint32)}


def within(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the asked keys, each searched in its own sorted range, and whether they are there."""
    lo, hi, end = lo.astype(np.int64), hi.astype(np.int64), hi.astype(np.int64)
    todo = np.nonzero(lo < hi)[0]
    while len(todo):
        mid = (lo[todo] + hi[todo]) >> 1
        less = keys[mid] < asked[todo]
        lo[todo[less]], hi[todo[~less]] = mid[less] + 1, mid[~less]
        todo = todo[lo[todo] < hi[todo]]
    there = lo < end
    there[there] = keys[lo[there]] == asked[there]
    return lo, there


def find(arrays: dict[str, np.ndarray], name: str, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    index = arrays[f"{name}_index"]
    bits = (len(index) - 1).bit_length() - 1
    bucket = (asked >> np.uint64(64 - bits)).astype(np.int64)
    return within(arrays[name], index[bucket], index[bucket + 1], (asked >> np.uint64(32 - bits)).astype(np.uint32))


# --- counting -----------------------------------------------------------------------------

BLOCKS = pa.schema([("shard", pa.int64()), *((n, pa.binary()) for n in ("a", "b", "b_runs", "c", "n"))])
PARTS = pa.schema([
    ("shard", pa.int64()),
    *((n, pa.binary()) for n in ("w", "types", "n", "pair_b", "pair_c", "pair_n")),
    ("hot", pa.list_(pa.struct([(n, pa.int64()) for n in ("b", "total", "n1", "n2", "n3")]))),
    ("triples", pa.list_(pa.int64())),
    ("pairs", pa.list_(pa.int64())),
])
PARTS_DDL = "shard long, w binary, types binary, n binary, pair_b binary, pair_c binary, pair_n binary, hot array<struct<b:bigint,total:bigint,n1:bigint,n2:bigint,n3:bigint>>, triples array<bigint>, pairs array<bigint>"


def count_ngrams(order: int, bits: int, hot: np.ndarray, slices: int, part: int):
    """mapInArrow: texts to blocks of counted triples (pairs under order two, with an empty a) by
    shard, those of one slice. Pairs with the start mark go to shards of their own, from 2**bits on."""

    def block(held: list[np.ndarray]) -> list[dict]:
        c = np.concatenate(held)
        b = np.concatenate([before(w) for w in held])
        first = np.zeros(len(c), bool)
        first[np.cumsum([0, *map(len, held[:-1])])] = True
        if order == 2:
            a = np.zeros(len(c), np.uint64)
            by = np.where(member(hot, b), pair_key(b, c), b)
        else:
            a = before(b)
            by = np.where(member(hot, b), pair_key(a, b), b)
        shard = shard_of(by, bits)
        if order > 2:
            shard[first] = (1 << bits) + shard_of(pair_key(b[first], c[first]), bits)
            a[first] = 0
        mine = shard % slices == part
        a, b, c, shard = a[mine], b[mine], c[mine], shard[mine]
        # Sorted by shard and triple; the hash only needs to bring equal ones together.
        key = pair_key(pair_key(a, b), c)
        rank = np.lexsort((key, b, shard))
        a, b, c, shard = a[rank], b[rank], c[rank], shard[rank]
        at = runs(shard, b, a, c)
        n, a, b, c, shard = np.diff(at, append=len(a)), a[at], b[at], c[at], shard[at]
        cuts = runs(shard)
        rows = []
        for lo, hi in ranges(cuts, len(a)):
            heads = runs(b[lo:hi])
            rows.append({"shard": int(shard[lo]), "a": a[lo:hi].tobytes() if order > 2 else b"", "b": b[lo:hi][heads].tobytes(), "b_runs": np.diff(heads, append=hi - lo).astype(np.uint32).tobytes(), "c": c[lo:hi].tobytes(), "n": n[lo:hi].astype(np.uint32).tobytes()})
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for words in tokens(batch.column(0)):
                held.append(words)
                size += len(held[-1])
                if size >= FLUSH:
                    yield pa.RecordBatch.from_pylist(block(held), BLOCKS)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(block(held), BLOCKS)

    return run


def joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column if x.is_valid] or [np.empty(0, kind)])


def store_pairs(uri: str, b: np.ndarray, c: np.ndarray, n: np.ndarray, hot: np.ndarray, more: dict[str, np.ndarray] = {}) -> list[dict]:  # noqa: B006
    """Writes the arrays of whole pairs and of their first words; the rows of hot first words."""
    key = spread(pair_key(b, c))
    rank = np.argsort(key)
    arrays = hashed("pair", key[rank]) | packed("pair_n", n[rank])
    rank = np.argsort(spread(b))
    heads = runs(b[rank])
    first, sums = b[rank][heads], kinds(n[rank], heads)
    loose = member(hot, first)
    arrays |= hashed("first", spread(first[~loose]))
    for name, x in zip(("total", "n1", "n2", "n3"), sums, strict=True):
        arrays |= packed(f"first_{name}", x[~loose])
    put_arrays(uri, arrays | more)
    own = [dict(zip(("b", "total", "n1", "n2", "n3"), map(int, x), strict=True)) for x in zip(first[loose].view(np.int64), *(x[loose] for x in sums), strict=True)]
    return [{"shard": -1, "hot": own, "pairs": of_counts(n)}]


def dealt(by: np.ndarray, bits: int, columns: dict[str, np.ndarray]) -> list[dict]:
    """Rows of blobs by shard of `by`."""
    to = shard_of(by, bits)
    rank = np.argsort(to, kind="stable")
    cuts = runs(to[rank])
    return [{"shard": int(to[rank[lo]])} | {k: v[rank[lo:hi]].tobytes() for k, v in columns.items()} for lo, hi in ranges(cuts, len(to))]


def merge_ngrams(model: str, order: int, bits: int, hot: np.ndarray):
    """applyInArrow by shard: writes the shard's arrays, passes words, and pairs of hot words, on."""

    def contexts(k: np.ndarray, c: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        heads = runs(k)
        followers = np.diff(heads, append=len(k))
        arrays = hashed("context", k[heads])
        starts = np.append(heads, len(k))[arrays["context_index"]]
        large = np.nonzero(followers > FEW)[0]
        arrays |= packed("followers", followers) | {"starts": starts.astype(np.uint32), "c": (c >> np.uint64(32)).astype(np.uint32)} | packed("n", n)
        arrays["large"] = large.astype(np.uint32)
        return arrays | {f"large_{name}": x[large] for name, x in zip(("total", "n1", "n2", "n3"), kinds(n, heads), strict=True)}

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b = np.repeat(joined(table["b"], np.uint64), joined(table["b_runs"], np.uint32))
        c, n = joined(table["c"], np.uint64), joined(table["n"], np.uint32).astype(np.int64)
        a = joined(table["a"], np.uint64) if order > 2 else np.zeros(len(b), np.uint64)
        shard = key[0].as_py()
        k = spread(pair_key(a, b)) if order > 2 else b
        rank = np.lexsort((c, k))
        at = runs(k[rank], c[rank])
        n = summed(n[rank], at)
        b, c, k = b[rank][at], c[rank][at], k[rank][at]
        if shard >= 1 << bits:  # pairs with the start mark
            return pa.Table.from_pylist(dealt(pair_key(b, c), bits, {"pair_b": b, "pair_c": c, "pair_n": n}), PARTS)
        rows = [{"shard": -1, "triples": of_counts(n)}] if order > 2 else []
        by_c = np.argsort(c)
        heads = runs(c[by_c])
        w, raw = c[by_c][heads], summed(n[by_c], heads)
        if order > 2:
            more = contexts(k, c, n)
            pk = pair_key(b, c)
            rank = np.argsort(pk)
            at = runs(pk[rank])
            pb, pc, pn = b[rank][at], c[rank][at], np.diff(at, append=len(pk))
            loose = member(hot, pb)
            rows += dealt(pk[rank][at][loose], bits, {"pair_b": pb[loose], "pair_c": pc[loose], "pair_n": pn[loose]}) if loose.any() else []
            pb, pc, pn = pb[~loose], pc[~loose], pn[~loose]
        else:
            pb, pc, pn, more = b, c, n, {}
        rows += store_pairs(f"{model}/grams-{shard}", pb, pc, pn, hot, more)
        types = np.bincount(np.searchsorted(w, pc), minlength=len(w))
        return pa.Table.from_pylist(rows + dealt(w, bits, {"w": w, "types": types.astype(np.uint32), "n": raw}), PARTS)

    return run


def merge_hot(model: str, bits: int, hot: np.ndarray):
    """applyInArrow by shard: adds the pairs of hot words up and writes them."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b, c, n = joined(table["pair_b"], np.uint64), joined(table["pair_c"], np.uint64), joined(table["pair_n"], np.int64)
        rank = np.argsort(pk := pair_key(b, c))
        at = runs(pk[rank])
        b, c, n = b[rank][at], c[rank][at], summed(n[rank], at)
        rows = store_pairs(f"{model}/hot-{key[0].as_py()}", b, c, n, hot)
        by_c = np.argsort(c)
        heads = runs(c[by_c])
        raw = summed(np.where(b == np.uint64(START), n, 0)[by_c], heads)  # the others are counted as triples
        w = c[by_c][heads]
        return pa.Table.from_pylist(rows + dealt(w, bits, {"w": w, "types": np.diff(heads, append=len(c)).astype(np.uint32), "n": raw}), PARTS)

    return run


def merge_words(model: str):
    """applyInArrow by shard: writes the word arrays; returns their sums."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        w, types, n = joined(table["w"], np.uint64), joined(table["types"], np.uint32), joined(table["n"], np.int64)
        rank = np.argsort(spread(w))
        heads = runs(w[rank])
        types, n = summed(types[rank], heads), summed(n[rank], heads)
        put_arrays(f"{model}/words-{key[0].as_py()}", hashed("word", spread(w[rank][heads])) | packed("n", n) | packed("types", types))
        return pa.table({"words": pa.array([len(n)]), "tokens": pa.array([int(n.sum())]), "types": pa.array([int(types.sum())]), "counts": [of_counts(types)]})

    return run


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts one, two, and three or more; each between 0 and its count."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return 0.5, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


@dataclass(frozen=True)
class Model:
    at: str
    order: int
    bits: int
    #: Sums of the hot words' followers: b, total, n1, n2, n3.
    hot: tuple[tuple[int, ...], ...]
    tokens: int
    words: int
    types: int
    triple_discounts: tuple[float, float, float]
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_rest: float


def frequent(docs: DataFrame, rows: int, least: float, hot: int, sample: int, text_col: str) -> np.ndarray:
    """Hashes of the words that make up more than `least` of about `sample` documents (of these the
    `hot` most frequent), and of the start mark."""
    text = text_of(text_col)
    some = docs.filter(F.pmod(F.xxhash64(text), F.lit(max(1, rows // sample))) == 0)
    words = some.select(F.explode(F.split(F.lower(text), SPACE_CLASS + "+")).alias("w")).filter("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 0
    top = words.filter(F.col("n") > least * total).orderBy(F.desc("n"), "w").limit(hot).collect()
    known = [words for words, _ in hashed_words(pa.array([r.w.encode() for r in top], pa.binary()))]
    return np.unique(np.concatenate([np.array([START], np.uint64), *known]))


def train(docs: DataFrame, order: int = 3, bytes_per_shard: int = 1 << 25, slices: int = 4, text_col: str = "text", hot: int = 10_000, hot_sample: int = 1000) -> Model:
    """Counts all rows of docs. Only sums over shards and the hot words come to the driver."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(text_of(text_col))).alias("bytes")).first()
    bits = max(6, math.ceil(math.log2(max(1, size.bytes or 0) / bytes_per_shard)))
    at = new_path(spark, "lm")
    known = frequent(docs, size.rows, 0.5 / (1 << bits), hot, hot_sample, text_col)
    texts = docs.select(text_of(text_col).cast("binary").alias("text"))

    def of_slice(part: int) -> DataFrame:
        blocks = texts.mapInArrow(count_ngrams(order, bits, known, slices, part), "shard long, a binary, b binary, b_runs binary, c binary, n binary")
        return durable(blocks.groupBy("shard").applyInArrow(merge_ngrams(at, order, bits, known), PARTS_DDL), "lm-parts")

    parts = reduce(DataFrame.unionByName, [of_slice(k) for k in range(slices)])
    if order > 2:
        loose = parts.filter("pair_b IS NOT NULL").groupBy("shard")
        parts = parts.unionByName(durable(loose.applyInArrow(merge_hot(at, bits, known), PARTS_DDL), "lm-hot"))
    sums = durable(parts.filter("w IS NOT NULL").select("shard", "w", "types", "n").groupBy("shard").applyInArrow(merge_words(at), "words long, tokens long, types long, counts array<bigint>"), "lm-sums")
    each = lambda c: [F.coalesce(F.sum(F.get(c, F.lit(i))), F.lit(0)) for i in range(4)]
    s = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "tokens", "types")], *each("counts")).first()
    p = parts.agg(*each("triples"), *each("pairs")).first()
    stats = parts.filter("hot IS NOT NULL").select(F.inline("hot")).groupBy("b").agg(*[F.sum(x).alias(x) for x in ("total", "n1", "n2", "n3")]).orderBy("b").collect()
    word, d = list(s[3:]), discounts(list(s[3:]))
    rest = (d[0] * word[0] + d[1] * word[1] + d[2] * (s[0] - word[0] - word[1])) / s[2] if s[2] else 1.0
    hot_rows = {START - (1 << 64) if START >> 63 else START: (0, 0, 0, 0)} | {int(b): (0, 0, 0, 0) for b in known.view(np.int64)} | {r.b: tuple(r)[1:] for r in stats}
    table = sorted((b % (1 << 64), *x) for b, x in hot_rows.items())
    return Model(at, order, bits, tuple(table), s[1], s[0], s[2], discounts(list(p[:4])), discounts(list(p[4:])), d, rest)


# --- scoring ------------------------------------------------------------------------------


class Reader:
    """A worker's view of a model: each shard is mapped when first asked for."""

    def __init__(self, model: Model):
        self.model, self.held = model, {}
        self.hot = np.array([x[0] for x in model.hot], np.uint64)
        self.hot_sums = np.array([x[1:] for x in model.hot], np.int64).reshape(-1, 4)

    def shard(self, kind: str, k: int) -> dict[str, np.ndarray]:
        if (kind, k) not in self.held:
            try:
                self.held[kind, k] = map_arrays(f"{self.model.at}/{kind}-{k}")
            except FileNotFoundError:
                self.held[kind, k] = {}
        return self.held[kind, k]

    def by_shard(self, kind: str, shard: np.ndarray) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
        """The arrays of each shard that is there, and the places that ask for it."""
        rank = np.argsort(shard, kind="stable")
        cuts = runs(shard[rank])
        for lo, hi in ranges(cuts, len(rank)):
            if arrays := self.shard(kind, int(shard[rank[lo]])):
                yield arrays, rank[lo:hi]

    def lookup(self, kind: str, key: str, shard: np.ndarray, asked: np.ndarray, fields: tuple[str, ...]) -> list[np.ndarray]:
        """Fields of the asked keys, zero where absent."""
        out = [np.zeros(len(asked), np.int64) for _ in fields]
        for arrays, mine in self.by_shard(kind, shard):
            at, there = find(arrays, key, asked[mine])
            for o, f in zip(out, fields, strict=True):
                o[mine[there]] = unpacked(arrays, f, at[there])
        return out

    def word_level(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw count and probability of each word by itself."""
        m = self.model
        some, back = np.unique(word, return_inverse=True)
        n, types = self.lookup("words", "word", shard_of(some, m.bits), spread(some), ("n", "types"))
        d = np.array((0, *m.word_discounts))
        p = m.word_rest / (m.words + 1) + (np.maximum(types - d[np.minimum(types, 3)], 0) / m.types if m.types else 0)
        return n[back], p[back] if m.types else np.full(len(word), p)

    def pair_level(self, first: np.ndarray, word: np.ndarray, lower: np.ndarray) -> np.ndarray:
        m = self.model
        some, back = np.unique(first, return_inverse=True)
        sums = np.array(self.lookup("grams", "first", shard_of(some, m.bits), spread(some), ("first_total", "first_n1", "first_n2", "first_n3"))).T
        loose = member(self.hot, some)
        sums[loose] = self.hot_sums[np.searchsorted(self.hot, some[loose])]
        key, rest = pair_key(first, word), member(self.hot, first)
        n = np.zeros(len(first), np.int64)
        if m.order == 2:
            (n,) = self.lookup("grams", "pair", shard_of(np.where(rest, key, first), m.bits), spread(key), ("pair_n",))
        else:
            for kind, mine, by in (("grams", ~rest, first), ("hot", rest, key)):
                (n[mine],) = self.lookup(kind, "pair", shard_of(by[mine], m.bits), spread(key[mine]), ("pair_n",))
        return mixed(n, sums[back], m.pair_discounts, lower)

    def triple_level(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, lower: np.ndarray) -> np.ndarray:
        m, key = self.model, pair_key(a, b)
        shard, asked, tail = shard_of(np.where(member(self.hot, b), key, b), m.bits), spread(key), (c >> np.uint64(32)).astype(np.uint32)
        sums, n = np.zeros((len(a), 4), np.int64), np.zeros(len(a), np.int64)
        for arrays, mine in self.by_shard("grams", shard):
            at, there = find(arrays, "context", asked[mine])
            at, mine = at[there], mine[there]
            if not len(at):
                continue
            # A context's followers begin after those of its bucket's earlier contexts.
            bucket = np.searchsorted(arrays["context_index"], at, side="right") - 1
            head = arrays["context_index"][bucket].astype(np.int64)
            lo = arrays["starts"][bucket].astype(np.int64) + ragged_sums(lambda x: unpacked(arrays, "followers", x), head, at)
            size = unpacked(arrays, "followers", at)
            place, hit = within(arrays["c"], lo, lo + size, tail[mine])
            n[mine[hit]] = unpacked(arrays, "n", place[hit])
            few = size <= FEW
            one = lambda f: ragged_sums(lambda x: f(unpacked(arrays, "n", x)), lo[few], lo[few] + size[few])  # noqa: E731, B023
            sums[mine[few]] = np.array([one(lambda x: x), one(lambda x: x == 1), one(lambda x: x == 2), one(lambda x: x > 2)]).T
            which = np.searchsorted(arrays["large"], at[~few])
            sums[mine[~few]] = np.array([arrays[f"large_{x}"][which] for x in ("total", "n1", "n2", "n3")]).T
        return mixed(n, sums, m.triple_discounts, lower)

    def score(self, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Raw count and log10 probability of each token of the texts."""
        c, b = np.concatenate(held), np.concatenate([before(w) for w in held])
        n, p = self.word_level(c)
        p = self.pair_level(b, c, p)
        if self.model.order > 2:
            later = np.ones(len(c), bool)
            later[np.cumsum([0, *map(len, held[:-1])])] = False
            p[later] = self.triple_level(before(b)[later], b[later], c[later], p[later])
        return n, np.log10(p)


def mixed(n: np.ndarray, sums: np.ndarray, discount: tuple[float, float, float], lower: np.ndarray) -> np.ndarray:
    """One level over the one below it; sums: of the context, total, n1, n2, n3."""
    d, total = np.array((0, *discount)), np.maximum(sums[:, 0], 1)
    own = np.maximum(n - d[np.minimum(n, 3)], 0) / total
    return np.where(sums[:, 0] > 0, own + (sums[:, 1:] @ d[1:]) / total * lower, lower)


def ragged_sums(values, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of values(places) over the ranges lo to hi."""
    size = hi - lo
    ends = np.cumsum(size)
    places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - size), size)
    sums = np.concatenate([[0], np.cumsum(values(places))])
    return sums[ends] - sums[ends - size]


_READER: dict[str, Reader] = {}


def reader(model: Model) -> Reader:
    if model.at not in _READER:
        _READER.clear()
        _READER[model.at] = Reader(model)
    return _READER[model.at]


def score(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, base_score (add-one unigram), score."""
    vocabulary = model.tokens + model.words + 1

    def several(held: list[np.ndarray]) -> list[np.ndarray]:
        sizes = np.array([len(w) for w in held])
        n, logs = reader(model).score(held)
        at = np.cumsum(sizes) - sizes
        base = np.log10((n + 1) / vocabulary)
        return [sizes, np.add.reduceat((n > 0).astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(logs, at)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, count, parts = [], 0, []
            for words in tokens(b.column(1)):
                held.append(words)
                count += len(held[-1])
                if count >= LOOKUP:
                    parts.append(several(held))
                    held, count = [], 0
            if held:
                parts.append(several(held))
            if parts:
                cols = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    ship(docs.sparkSession)
    typed = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    return typed.mapInArrow(run, f"doc_id {typed.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double")


def held_out(id_col: str = "doc_id", folds: int = 7, fold: int = 2):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def score_held_out(docs: DataFrame, **options) -> DataFrame:
    """Learns from all rows but one fold of ids and scores all of them; see op9's contract."""
    model = train(docs.filter(~held_out()), **options)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
