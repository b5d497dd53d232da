"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.session import durable_table


def connected(edges: DataFrame) -> DataFrame:
    """(a, b) pairs -> (node, root): the smallest node of each node's component; nodes without an edge are not returned.

    Alternates two steps on the edges. Large star: a node links its larger
    neighbours to its smallest one. Small star: it links its smaller neighbours,
    and itself, to the smallest. Both only re-hang edges, so their number doesn't
    grow, and components shrink to stars in a number of rounds that follows the
    logarithm of their size. Each round is written to the shared folder; edges
    that are stars already need none. Of one node's neighbours only the smallest
    is worked out, by partial aggregation, and joined back, so a node with very
    many neighbours is never gathered in one place.
    """
    now = durable_table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not _stars(now):
        both = now.union(now.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # each edge hangs b below a < b
        large = both.join(low, "u").where("v > u AND v > m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        lowest = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lowest, "b").select("m", F.explode(F.array("a", "b")).alias("v"))
        now = durable_table(small.where("v > m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct())
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs below one other, which hangs below none."""
    roles = edges.select(F.col("b").alias("n"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("a", F.lit(0), F.lit(1)))
    wrong = roles.groupBy("n").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 OR below = 1 AND above = 1")
    return wrong.isEmpty()


def hang(pairs: list[tuple]) -> list[tuple]:
    """Pairs of one task -> the same components as stars: (smallest, other)."""
    above: dict = {}

    def find(x):
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = up
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            above[max(a, b)] = min(a, b)
    return [(root, x) for x in list(above) if (root := find(x)) != x]
