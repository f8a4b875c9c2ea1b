"""Connected components of a link table, by alternating star contractions.

Every round first links the larger neighbours of each node to its smallest
neighbour, then the smaller ones.  The number of links never grows, each round
is a grouped minimum and a join, and each is written to the shared folder, so
a lost executor costs one round's tasks at most.  A node with very many links
is a grouped minimum with partial sums and a join whose large side Spark can
split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurelog.staging import staged


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    # Here a > b in every row.
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    joined = links.join(least, "a")
    moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """Rows ``(node, root)`` for every node of ``links(a, b)``; the root is the smallest node reachable."""
    oriented = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = staged(oriented, "links")
    before = _state(current)
    while True:
        current = staged(_small_star(_large_star(current)), "links")
        after = _state(current)
        if after == before:
            break
        before = after
    leaves = current.groupBy("a").agg(F.min("b").alias("root"))
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return leaves.select(F.col("a").alias("node"), "root").union(roots)
