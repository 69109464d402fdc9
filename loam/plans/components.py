"""Connected components by alternating large-star and small-star.

A round is two distributed joins; minima are combined before the shuffle, and the joins have one row per node on one
side, so adaptive execution can split a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.session import cut


def _large_star(links: DataFrame) -> DataFrame:
    """``(u, v, changed)``: every neighbour that is larger than ``u`` is tied to the smallest of u's neighbourhood."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    moved = both.where(F.col("v") > F.col("u")).join(low, "u")
    return _distinct(moved.select(F.col("v").alias("u"), F.col("low").alias("v"), (F.col("low") != F.col("u")).alias("changed")))


def _small_star(links: DataFrame) -> DataFrame:
    """``(u, v, changed)``: ``u`` and its smaller neighbours are tied to the smallest of them; links go down."""
    low = links.groupBy("u").agg(F.min("v").alias("low"))
    moved = links.join(low, "u")
    own = F.struct(F.col("u").alias("u"), F.col("low").alias("v"), F.col("changed").alias("changed"))
    other = F.struct(F.col("v").alias("u"), F.col("low").alias("v"), F.lit(True).alias("changed"))
    pairs = F.when(F.col("v") == F.col("low"), F.array(own)).otherwise(F.array(own, other))
    return _distinct(moved.select(F.inline(pairs)))


def _distinct(links: DataFrame) -> DataFrame:
    return links.where("u != v").groupBy("u", "v").agg(F.max("changed").alias("changed"))


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` of every node of ``links`` (longs ``u`` and ``v``); loops only tie a node to itself.

    Each round is cut in the checkpoint folder.  The rounds end when no link was rewritten, which is exact; after
    ``max_rounds`` (the number needed grows with the logarithm of the largest component) it fails loudly.
    """
    nodes = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), F.lit(True).alias("changed"))
    state = cut(_distinct(down))
    for _ in range(max_rounds):
        large = _large_star(state)
        state = cut(_small_star(large))
        if not state.where("changed").limit(1).count():
            return nodes.join(state.select(F.col("u").alias("node"), F.col("v").alias("low")), "node", "left").select(
                "node", F.coalesce("low", "node").alias("component")
            )
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
