"""Connected components of an edge list, by alternating stars.

Each round makes every node's neighbours point to the least among them, first those above it, then
those below; it ends when a round changes nothing, after rounds that grow with the logarithm of the
component. Minima are aggregated before they are shuffled, and a hub's rows join its one minimum,
so Spark can split them. Every round is cut by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def star(links: DataFrame) -> DataFrame:
    """links: (a, b) in both directions or one; every b goes with the least of a's neighbours and a itself."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return links.join(least, "a")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of its component, for nodes of at least one edge (a, b) of two different nodes."""
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    seen = None
    while (now := edges.select(state).first()) != seen:
        seen = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = star(large)
        edges = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
    tips = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return tips.union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
