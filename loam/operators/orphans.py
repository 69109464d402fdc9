"""References to records that do not exist, are deleted or arrive later (problem 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.fold import present_fold
from loam.functions.instants import canonical_us, with_agent
from loam.operators.instants import edge_instant

_DAY_US = 86_400_000_000


def month_of(us: Column) -> Column:
    """UTC month ``YYYY-MM`` of microseconds, ``unknown`` for null; independent of the session's zone."""
    day = F.date_from_unix_date(F.floor(us / F.lit(_DAY_US)).cast("int"))
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("unknown"))


def edge_references(edges: DataFrame, agents: DataFrame) -> DataFrame:
    """``(edge_id, field, key, created_us)``: both references of each edge, folded; null and blank ones are none."""
    rows = with_agent(edges.select("id", "from_id", "to_id", "created_at", "agent"), agents)
    both = F.array(*[F.struct(F.lit(f).alias("field"), present_fold(F.col(f)).alias("key")) for f in ("from_id", "to_id")])
    return (
        rows.select(F.col("id").cast("long").alias("edge_id"), edge_instant("created_at").alias("created_us"), both.alias("refs"))
        .select("edge_id", "created_us", F.inline("refs"))
        .where(F.col("key").isNotNull())
    )


def parent_state(nodes: DataFrame) -> DataFrame:
    """Per folded node id: whether it is deleted and its earliest creation.  Null and blank ids are no parents."""
    dead = F.coalesce(F.get_json_object("metadata", "$.tombstoned") == "true", F.lit(False))
    return (
        nodes.select(present_fold(F.col("id")).alias("key"), dead.alias("dead"), canonical_us(F.col("created_at")).alias("us"))
        .where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.max("dead").alias("deleted"), F.min("us").alias("first_us"))
    )


def suspect_keys(references: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(key, state, first_us)``: one row per foreign key that is missing, deleted or created after its earliest use.

    Distinct foreign keys (with the earliest edge that uses each, combined before the shuffle) are anti-joined
    against the parents; those that exist are kept only if deleted or created after that earliest edge.
    """
    keys = references.groupBy("key").agg(F.min("created_us").alias("first_use"))
    parents = parent_state(nodes)
    missing = keys.join(parents, "key", "left_anti").select("key", F.lit("missing").alias("state"), F.lit(None).cast("long").alias("first_us"))
    suspect = keys.join(parents, "key").where(F.col("deleted") | (F.col("first_us") > F.col("first_use")))
    state = F.when(F.col("deleted"), "deleted").otherwise("late")
    return missing.unionByName(suspect.select("key", state.alias("state"), "first_us"))


def bad_references(edges: DataFrame, nodes: DataFrame, agents: DataFrame) -> DataFrame:
    """``(edge_id, field, reason, period)`` of each reference that is missing, deleted or late.

    Only the suspect keys are joined back to the edges.  The join's skewed side is split by adaptive execution: its
    other side has one row per key.  Edges without an instant are never late.  Empty tables give no rows, but an
    empty ``nodes`` makes every reference missing.
    """
    references = edge_references(edges, agents)
    return (
        references.join(suspect_keys(references, nodes), "key")
        .where((F.col("state") != "late") | (F.col("first_us") > F.col("created_us")))
        .select("edge_id", "field", F.col("state").alias("reason"), month_of(F.col("created_us")).alias("period"))
    )


def reference_report(edges: DataFrame, nodes: DataFrame, agents: DataFrame) -> DataFrame:
    """Per field and period: references and how many are missing, deleted and late; every reference meets the suspect keys
    once."""
    references = edge_references(edges, agents).select("field", "key", "created_us")
    told = references.join(suspect_keys(references, nodes), "key", "left")
    count = lambda c: F.count(F.when(c, 1))
    late = (F.col("state") == "late") & (F.col("first_us") > F.col("created_us"))
    return told.groupBy("field", month_of(F.col("created_us")).alias("period")).agg(
        F.count(F.lit(1)).alias("n_references"), count(F.col("state") == "missing").alias("n_missing"), count(F.col("state") == "deleted").alias("n_deleted"), count(late).alias("n_late")
    )
