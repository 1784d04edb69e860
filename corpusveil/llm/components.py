"""Connected components by alternating large and small stars.

Each round rewires every node to the smallest node it sees; the number of rounds grows with
the logarithm of the longest path, and the edges never outgrow what came in. Each round is a
table in the shared folder, so a lost executor costs one round at most. Hot nodes are
combined map-side for their minimum; the minima are a table too, since AQE splits a hot node
only in a join of two plain exchanges.

Defined cases: self-links and repeated edges are harmless; rows with a null end are ignored;
no edges give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    least = durable(both.groupBy("a").agg(F.min("b").alias("m")), "least")
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = durable(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b of an ordered type. node, root (the smallest node of its component) for every
    node that has a link to another."""
    down = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = durable(down, "stars"), None
    while True:
        sums = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (sums.n, sums.x) == mark or not sums.n:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = (sums.n, sums.x)
        large = durable(_large_star(now).distinct(), "stars")
        now = durable(_small_star(large).distinct(), "stars")
