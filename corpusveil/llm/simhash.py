"""SimHash near-duplicates with vantage-point trees.

Fingerprint: texts with A-Z in lower case, words by the word rule, shingles of `width` words
(repeats included; fewer words: the whole sequence; none: fingerprint zero), XXH64 with seed
42 of each; a bit is set when more than half of the hashes set it. Two fingerprints link when
at most `radius` bits differ; a component is what links reach.

Search: distances of random 64-bit fingerprints pile up at 32, where a radius of 4 prunes
little. So there is one tree per block of bits: of `blocks` blocks, one must differ in at
most radius // blocks bits, and in that block the triangle bound is tight. Each tree splits a
block's Hamming distance to a vantage point at the median; a fingerprint's home is one leaf,
and it is sent as a query to each leaf that its ball overlaps. A ball on one side of a cut goes
there whole (the triangle bound); one that straddles a cut is followed value by value from there,
so no leaf is visited that holds none of the ball's values: with 22 bits and one differing bit 23
visits a block at most, however many leaves there are. Leaves are shards: each shard goes on
splitting its own points the same way and compares what is left exactly, over all 64 bits. The
trees' top levels come from a sample of `per_leaf` fingerprints a leaf, which only steers
balance: links are exact whatever it holds.

Equal fingerprints are collapsed before the search, so a group of copies is one point, and a
shard reports a spanning forest of its links, never all pairs of a group.

Defined cases: a null text counts as empty; texts without words share fingerprint zero and
link like any other; repeated rows are linked to each other; null ids do not count as the
smallest id and get their component's; an empty table gives an empty result. Columns other
than doc_id and text are not read.

Scale: each fingerprint is sent to a number of shards that grows with `levels` and stays under
blocks * 23 (measured on random ones: 10 at 5 levels, README has more). `levels` grows by one for
each doubling over 32 shards of `leaf_rows`, and with it the sample on the driver, which is a
`per_leaf` / `leaf_rows` part (1 in 3906) of the distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from .common import durable, text_of
from .components import components

BITS = 64
SEED = 42
CHUNK = 1 << 16
#: Vantage points that a node of a tree chooses from.
TRIED = 16


def fingerprint(text: bytes, width: int = 4) -> int:
    """The fingerprint as an unsigned integer. bytes.lower and bytes.split know ASCII only."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    votes = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        hashes = np.array([digest(s, SEED) for s in shingles], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def row_key(text_col: str, id_col: str) -> Column:
    """The same for rows of one id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit("\n"), text_of(text_col))))


def fingerprints(docs: DataFrame, width: int = 4, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, row (its row_key), fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=["doc_id", "row", "fp"])

    ship(docs.sparkSession)
    typed = docs.select(F.col(id_col).alias("doc_id"), row_key(text_col, id_col).alias("row"), text_of(text_col).cast("binary").alias("text"))
    return typed.mapInArrow(run, f"doc_id {typed.schema['doc_id'].dataType.simpleString()}, row binary, fp long")


def block_masks(blocks: int) -> list[int]:
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def distance(points: np.ndarray, pivot: np.ndarray, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((points ^ pivot) & mask).astype(np.int16)


class Tree:
    """The top levels of a vantage-point tree over one block, as a heap of pivots and cuts."""

    def __init__(self, mask: int, slack: int, levels: int, sample: np.ndarray):
        self.mask, self.slack, self.levels = np.uint64(mask), slack, levels
        self.pivots, self.cuts = np.zeros(1 << levels, np.uint64), np.zeros(1 << levels, np.int16)
        bits = [np.uint64(1 << b) for b in range(BITS) if mask >> b & 1]
        #: What the values of a ball differ by from its centre.
        self.flips = np.array([sum(c, np.uint64(0)) for n in range(slack + 1) for c in combinations(bits, n)], np.uint64)
        held = {1: sample}
        for node in range(1, 1 << levels):
            points = held.pop(node, sample[:0])
            inside = np.zeros(len(points), bool)
            self.cuts[node] = mask.bit_count() // 2
            # Of a few vantage points and the cuts beside the median, the most even split.
            for pivot in points[:: -(-len(points) // TRIED) or 1]:
                d = distance(points, pivot, self.mask)
                for cut in (int(np.median(d)), int(np.median(d)) + 1):
                    if abs(2 * (d < cut).sum() - len(d)) <= abs(2 * inside.sum() - len(d)):
                        inside, self.pivots[node], self.cuts[node] = d < cut, pivot, cut
            held[2 * node], held[2 * node + 1] = points[inside], points[~inside]

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each visit: the point's index, the leaf, whether it is the point's home."""
        whole = np.arange(len(points)), np.ones(len(points), np.int64)
        at, flip, node = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        for _ in range(self.levels):
            d, cut = distance(points[at] ^ self.flips[flip], self.pivots[node], self.mask), self.cuts[node]
            node = 2 * node + (d >= cut)
            own, own_node = whole
            d, cut = distance(points[own], self.pivots[own_node], self.mask), self.cuts[own_node]
            right, apart = d >= cut, (d - self.slack < cut) & (d + self.slack >= cut)
            whole = own[~apart], (2 * own_node + right)[~apart]
            # From here on each value of the ball goes its own way; those of one leaf meet again.
            values = np.tile(np.arange(len(self.flips)), int(apart.sum()))
            mine, under = (np.repeat(x[apart], len(self.flips)) for x in (own, own_node))
            d = distance(points[mine] ^ self.flips[values], self.pivots[under], self.mask)
            at, flip = np.concatenate([at, mine]), np.concatenate([flip, values])
            node = np.concatenate([node, 2 * under + (d >= self.cuts[under])])
        first = np.lexsort((flip, node, at))
        at, flip, node = at[first], flip[first], node[first]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (node[1:] != node[:-1])
        at, flip, node = at[new], flip[new], node[new]
        at, node = np.concatenate([whole[0], at]), np.concatenate([whole[1], node])
        home = np.concatenate([np.ones(len(whole[0]), bool), flip == 0])
        return at, node - (1 << self.levels), home


class Forest:
    """Union-find over a shard's points; linked() takes pairs and keeps no list of them."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, i: np.ndarray) -> np.ndarray:
        r = self.up[i]
        while not np.array_equal(nxt := self.up[r], r):
            r = nxt
        self.up[i] = r
        return r

    def linked(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.roots(i), self.roots(j)
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def search(points: np.ndarray, home: np.ndarray, mask: np.uint64, slack: int, radius: int, leaf: int = 1 << 21) -> Forest:
    """Links every home point with each point in its ball; home: indices."""
    forest, whole = Forest(len(points)), np.uint64(2**64 - 1)
    todo = [(home, np.arange(len(points)), mask, slack)]
    while todo:
        own, asked, m, s = todo.pop()
        if not len(own) or not len(asked):
            continue
        if len(own) * len(asked) > leaf:
            pivot = points[own[len(own) // 2]]
            do, dq = distance(points[own], pivot, m), distance(points[asked], pivot, m)
            cut = int(np.median(do))
            cut += int(cut == do.min())
            inside = do < cut
            if not inside.all():
                todo += [(own[inside], asked[dq - s < cut], m, s), (own[~inside], asked[dq + s >= cut], m, s)]
                continue
            if m != whole:  # the block no longer tells these apart
                todo.append((own, asked, whole, radius))
                continue
        step = max(1, leaf // len(asked))
        for k in range(0, len(own), step):
            some = own[k : k + step]
            near = np.bitwise_count(points[some][:, None] ^ points[asked][None, :]) <= radius
            i, j = np.nonzero(near)
            forest.linked(some[i], asked[j])
    return forest


def links(distinct: DataFrame, radius: int = 4, blocks: int = 3, levels: int | None = None, per_leaf: int = 64, leaf_rows: int = 250_000) -> DataFrame:
    """distinct: one row per fingerprint, column fp. Edges (a, b) of a spanning forest of each
    shard's links."""
    rows = distinct.count()
    if levels is None:
        levels = 5 + max(0, int(np.ceil(np.log2(max(1, rows) / (32 * leaf_rows)))))
    part = max(1, rows // (max(64, 1 << levels) * per_leaf))
    some = [r.fp for r in distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(part)) == 0).select("fp").sort("fp").collect()]
    steer = np.array(some, np.int64).view(np.uint64)
    trees = [Tree(m, radius // blocks, levels, steer) for m in block_masks(blocks)]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, tree in enumerate(trees):
                at, leaf, home = tree.route(points)
                yield pa.RecordBatch.from_arrays([pa.array((leaf + (k << levels)).astype(np.int32)), pa.array(points[at].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    def match(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tree = trees[key[0].as_py() >> levels]
        points, first = np.unique(table.column("fp").to_numpy().view(np.uint64), return_index=True)
        home = np.nonzero(table.column("home").to_numpy(zero_copy_only=False)[first])[0]
        up = search(points, home, tree.mask, tree.slack, radius)
        at = np.arange(len(points))
        root = up.roots(at)
        tied = root != at
        return pa.table({"a": points[tied].view(np.int64), "b": points[root[tied]].view(np.int64)})

    ship(distinct.sparkSession)
    visits = distinct.select("fp").mapInArrow(route, "shard int, fp long, home boolean")
    return visits.groupBy("shard").applyInArrow(match, "a long, b long")


def grouped(docs: DataFrame, radius: int, width: int, text_col: str, id_col: str, **search_options) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, row, fp) and, for each fp, component_id, component_size, and the row that
    stands for the component: that of the smallest id, then the smallest row_key."""
    marked = durable(fingerprints(docs, width, text_col, id_col), "fingerprints")
    best = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    distinct = durable(marked.groupBy("fp").agg(F.min(best).alias("first"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    edges = durable(links(distinct, radius, **search_options).distinct(), "simhash-links")
    roots = components(edges)
    named = durable(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    # A table, so that AQE can split a root with many fingerprints in the join.
    groups = durable(named.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("component_size")), "simhash-components")
    of = named.select("fp", "root").join(groups, "root").select("fp", F.col("first.doc_id").alias("component_id"), "component_size", F.col("first.row").alias("stands"))
    return marked, of


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, text_col: str = "text", id_col: str = "doc_id", **search_options) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest
    doc_id of its component), component_size."""
    marked, of = grouped(docs, radius, width, text_col, id_col, **search_options)
    return marked.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_size")


def dedup(docs: DataFrame, radius: int = 4, width: int = 4, text_col: str = "text", id_col: str = "doc_id", **search_options) -> DataFrame:
    """One document of each component, in its own columns: the one of the smallest id, and where
    ids repeat that of the smallest hash of id and text; of equal rows one stays."""
    _, of = grouped(docs, radius, width, text_col, id_col, **search_options)
    stay = of.select(F.col("stands").alias("__row")).distinct()
    keyed = docs.withColumn("__row", row_key(text_col, id_col))
    return keyed.join(stay, "__row", "left_semi").dropDuplicates(["__row"]).drop("__row")
