"""Connected components of links by rounds of star making, each a Spark job.

The links of a graph turn into stars around each part's smallest node in a number of rounds
that grows with the logarithm of the longest path. No node's neighbours are ever gathered:
each round takes minima (combined before the shuffle) and joins them back, where Spark may
split a hot node's rows. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from abstracta.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``a, b`` to ``node, part``: the smallest node that each linked node can reach."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    while True:
        large = _star(links, both_ways=True)
        small = stored(_star(large, both_ways=False), "links")
        # Stable when every node has one smaller neighbour, and that one has none.
        many = small.groupBy("a").count().where("count > 1").select("a")
        inner = small.select("a").intersect(small.select(F.col("b").alias("a")))
        if many.isEmpty() and inner.isEmpty():
            return small.select(F.col("a").alias("node"), F.col("b").alias("part")).unionByName(
                small.select(F.col("b").alias("node"), F.col("b").alias("part")).distinct()
            )
        links = small


def _star(links: DataFrame, both_ways: bool) -> DataFrame:
    """Link neighbours to the smallest of them: all larger ones, or all smaller ones and the node."""
    if both_ways:
        ends = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            links.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        made = ends.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        ends = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = ends.groupBy("u").agg(F.min("v").alias("m"))
        made = ends.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        made = made.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return made.where("a > b").distinct()
