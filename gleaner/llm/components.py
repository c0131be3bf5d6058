"""Connected components of a link table, by star contraction in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleaner.session import stored


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) of every node that has a link.

    Alternating large-star and small-star rounds: every round is two groupings
    with map-side partial minima, links only shrink towards their roots, and
    each round's links are written to the shared folder, so a lost executor
    costs a re-read. A round never joins a node's links with each other, so a
    node with very many links makes no more rows than it has links. Only the
    question whether a round changed anything comes to the driver. Empty links
    give an empty table.
    """
    edges = stored(
        links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .distinct()
    )
    before = None
    while True:
        # Large star: each neighbour above a node goes to the smallest among the node and its neighbours.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each neighbour below a node, and the node itself, goes to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.union(least).where("u <> v")
        edges = stored(small.distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = tuple(state)

