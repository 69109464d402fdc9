"""Fusion of ranked lists: reciprocal rank, weighted and maximum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def ranks(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rank of each hit of a list that was cut to its top, best first; ties by key."""
    return hits.select(key, "score", F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("rank"))


def rrf(lists: list[DataFrame], key: str = "doc_id", k: int = RRF_K, weights: list[float] | None = None) -> DataFrame:
    """``key, rrf_score, n_lists``: sum of ``weight / (k + best rank in the list)``; ``k`` must be above 0."""
    if k <= 0:
        raise ValueError("k must be above 0")
    parts = [ranks(x, key).select(key, "rank", F.lit(i).alias("list"), F.lit((weights or [1.0] * len(lists))[i]).alias("w")) for i, x in enumerate(lists)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    best = rows.groupBy(key, "list").agg(F.min("rank").alias("rank"), F.max("w").alias("w"))
    return best.groupBy(key).agg(F.sum(F.col("w") / (k + F.col("rank"))).alias("rrf_score"), F.count(F.lit(1)).alias("n_lists"))


def maximum(lists: list[DataFrame], key: str = "doc_id") -> DataFrame:
    rows = lists[0]
    for x in lists[1:]:
        rows = rows.unionByName(x)
    return rows.groupBy(key).agg(F.max("score").alias("score"))


def blend(passes: list[DataFrame], weights: list[float], key: str = "doc_id") -> DataFrame:
    """``key, score``: weighted sum of the best score of each pass; a pass without the key adds nothing."""
    rows = None
    for i, p in enumerate(passes):
        part = p.select(key, "score", F.lit(i).alias("pass"))
        rows = part if rows is None else rows.unionByName(part)
    sums = [F.coalesce(F.max(F.when(F.col("pass") == i, F.col("score"))), F.lit(0.0)) * w for i, w in enumerate(weights)]
    total = sums[0]
    for s in sums[1:]:
        total = total + s
    return rows.groupBy(key).agg(total.alias("score"))
