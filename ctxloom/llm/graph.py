"""Connected components over an edge table, by alternating large and small stars."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_split, often, spill


def _large(e: DataFrame, total: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    return join_split(both, low, "a", often(low, "a", 2 * total)).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(e: DataFrame, total: int) -> DataFrame:
    low = e.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    rest = join_split(e, low, "a", often(low, "a", total)).filter("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
    return rest.unionByName(low.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node reachable.

    Each round is written to the shared folder; rounds grow with the logarithm of the longest path.
    Loops and repeated edges do no harm; no edges give an empty table.
    """
    x, y = F.col(a), F.col(b)
    e = spill(edges.filter(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "cc")
    mark = None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first())
        if now == mark or not now[0]:
            break
        mark = now
        e = spill(_large(e, now[0]).distinct(), "cc")
        e = spill(_small(e, 2 * now[0]).distinct(), "cc")
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
