"""Connected components of a graph given as a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from undertow.llm.checkpoints import cut


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """One step: the neighbours of every node that are larger than it (or, else, smaller, with itself) are linked
    to the smallest of its neighbours and itself. Minima are aggregated before they meet the links, so a node
    that has a large share of the links costs a partial aggregate and a join that can be split."""
    if larger:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        out = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        joined = down.join(least, F.col("a") == F.col("n"))
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node with a link to another.

    Each round links every node to the smallest neighbour in two steps; their number grows with the logarithm of
    the longest path. It ends when a round changes nothing, seen from a count and a sum of hashes, so the driver
    never sees links. Every round is cut in the checkpoint folder. Nulls, loops and repeated links are ignored;
    no links give no rows.
    """
    now = cut(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        now = cut(_star(_star(now, larger=True), larger=False))
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = seen
