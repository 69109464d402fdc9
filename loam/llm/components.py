"""Consolidating pairwise matches into groups by alternating large-star and small-star (problem 7).

Names become order-preserving numbers first (range-sorted distinct names), so the smallest number of a component
is its smallest name and the rounds (``loam.plans.components``) move two longs per link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.plans.components import components
from loam.session import cut


def group_names(pairs: DataFrame, left: str, right: str, clean: Column | None = None) -> DataFrame:
    """``(name, group_name)``: each distinct name of two string columns with the smallest name it is tied to.

    A null on one side ties nothing but the other name still counts; rows may repeat.  An empty table gives none.
    """
    ties = pairs.select(F.col(left).alias("a"), F.col(right).alias("b")).distinct()
    names = ties.select(F.explode(F.array("a", "b")).alias("name")).where(F.col("name").isNotNull()).distinct()
    numbered = cut(names.repartitionByRange("name").sortWithinPartitions("name").withColumn("no", F.monotonically_increasing_id()))
    whole = ties.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    links = whole.join(numbered.select(F.col("name").alias("a"), F.col("no").alias("u")), "a").join(
        numbered.select(F.col("name").alias("b"), F.col("no").alias("v")), "b"
    )
    found = components(cut(links.select("u", "v")))
    named = found.join(numbered.select(F.col("no").alias("component"), F.col("name").alias("group_name")), "component")
    return numbered.join(named.select(F.col("node").alias("no"), "group_name"), "no", "left").select("name", F.coalesce("group_name", "name").alias("group_name"))


def alias_groups(aliases: DataFrame) -> DataFrame:
    """Groups of alias and canonical names, lower-cased and without outer white space."""
    clean = lambda c: F.lower(F.regexp_replace(F.col(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return group_names(aliases.select(clean("alias").alias("alias"), clean("canonical").alias("canonical")), "alias", "canonical")
