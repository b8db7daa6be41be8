"""Connected components of a link table by alternating star steps, with a written table after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrid.llm.common import discard, store


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """Rows (a, b) of links to rows (node, root): the smallest node that each linked node reaches.

    Every round joins each node's neighbours to the smallest of them (large star: the larger neighbours; small star:
    the smaller ones), so that hot nodes are handled by partial aggregation and split joins. Links of a node to
    itself and repeated links are harmless; an empty table gives an empty one. Rounds grow with the logarithm of
    the longest chain; they end when every node that has a smaller neighbour has no other one.
    """
    links = store(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = _both(links)
        groups = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        if not groups.where("m < a AND n > 1").agg(F.count(F.lit(1))).first()[0]:
            break
        least = groups.select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        old, links = links, store(small.where("a <> b").distinct(), "links")
        discard(old)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components ``found`` (node, root) after further links (a, b) between their nodes, or nodes without a row, which are alone so far.

    Only the roots that the links join go through the rounds.
    """
    for c in "ab":
        root = found.select(F.col("node").alias(f"n_{c}"), F.col("root").alias(f"r_{c}"))
        links = links.join(root, F.col(c) == F.col(f"n_{c}"), "left")
    above = components(links.select(*(F.coalesce(f"r_{c}", c).alias(c) for c in "ab")))
    up = above.select(F.col("node").alias("from_"), F.col("root").alias("to_"))
    moved = found.join(up, F.col("root") == F.col("from_"), "left").select("node", F.coalesce("to_", "root").alias("root"))
    return moved.unionByName(above.join(found.select("node"), "node", "left_anti"))
