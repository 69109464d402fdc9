"""Overlapping and gapped validity intervals: continuous periods and the gaps between them (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.fold import fold, not_blank
from loam.functions.instants import canonical_us, with_agent
from loam.operators.instants import edge_instant
from loam.plans.ordered import TARGET_ROWS, bucketed
from loam.session import cut

OPEN_US = 2**63 - 1


def open_end(value: Column) -> Column:
    """True for the forms of an end that is still open."""
    return ~not_blank(value) | F.lower(F.trim(value)).isin("now", "none")


def temporal_intervals(edges: DataFrame, agents: DataFrame) -> DataFrame:
    """Valid intervals of temporal edges: ``entity_key, relation_key, start_us, end_us`` and the edge's own
    ``id, to_id, created_us`` (lazily; unused ones are pruned).

    Rows with a blank ``from_id``, a start that is no instant, or an end that is not after the start give none; a
    null relation has the key ``''``; an open end is ``OPEN_US``.
    """
    rows = edges.select("id", "from_id", "relation", "to_id", "valid_from", "valid_until", "created_at", "graph_type", "agent")
    rows = rows.where((F.col("graph_type") == "temporal") & not_blank(F.col("from_id")))
    end = F.when(open_end(F.col("valid_until")), F.lit(OPEN_US)).otherwise(canonical_us(F.col("valid_until")))
    return (
        with_agent(rows, agents)
        .select(
            fold(F.col("from_id")).alias("entity_key"),
            F.coalesce(fold(F.col("relation")), F.lit("")).alias("relation_key"),
            edge_instant("valid_from").alias("start_us"),
            end.alias("end_us"),
            F.col("id").cast("long").alias("id"),
            "to_id",
            "created_at",
            "_zone",
            "_order",
        )
        .where(F.col("start_us").isNotNull() & (F.col("end_us") > F.col("start_us")))
    )


def periods_and_gaps(intervals: DataFrame, keys: list[str], target_rows: int = TARGET_ROWS) -> DataFrame:
    """Periods and gaps of ``intervals`` (``keys``, ``start_us``, ``end_us``; ``OPEN_US`` is open).

    Starts and ends are counted and ranked independently.  With ``i`` intervals started and ``i`` ended, the next
    start is after the ``i``-th end: a gap.  Equal starts (and equal ends) are combined before they are ranked,
    which changes no gap: a repeated start of rank ``i + 1`` is never after the ``i``-th end.  Touching intervals
    are unbroken.  Returns ``keys, kind, start_us, end_us`` with -1 for an open end.
    """
    side = F.array(F.struct(F.lit(0).alias("side"), F.col("start_us").alias("at")), F.struct(F.lit(1).alias("side"), F.col("end_us").alias("at")))
    events = cut(intervals.select(*keys, F.inline(side)).groupBy(*keys, "side", "at").agg(F.count(F.lit(1)).alias("n")))
    cuts = bucketed(events, [*keys, "side"], "at", target_rows)
    ranked = cuts.running_total("n", "upto", "total").df
    # the rank at which a start follows an end: intervals started before it, or ended up to it
    started = F.col("side") == 0
    rank = F.when(started, F.col("upto") - F.col("n")).otherwise(F.col("upto"))
    pairs = (
        ranked.select(*keys, rank.alias("rank"), "side", "at", "total")
        .groupBy(*keys, "rank")
        .agg(F.min(F.when(started, F.col("at"))).alias("opens"), F.min(F.when(~started, F.col("at"))).alias("closes"), F.max("total").alias("total"))
    )
    edge = (F.col("rank") == 0) | (F.col("rank") == F.col("total")) | (F.col("opens") > F.col("closes"))
    edges = pairs.where(edge).select(*keys, "rank", "opens", "closes")
    if cuts.hot:  # else no key has more boundaries than one task should hold
        paired = bucketed(cut(edges), keys, "rank", target_rows).neighbours({}, {"until": "closes"}).df
    else:
        paired = edges.withColumn("until", F.lead("closes").over(Window.partitionBy(*keys).orderBy("rank")))
    gap = F.when((F.col("rank") > 0) & F.col("opens").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("closes").alias("start_us"), F.col("opens").alias("end_us")))
    period = F.when(F.col("opens").isNotNull(), F.struct(F.lit("period").alias("kind"), F.col("opens").alias("start_us"), F.col("until").alias("end_us")))
    return (
        paired.select(*keys, F.explode(F.array(gap, period)).alias("x"))
        .where(F.col("x").isNotNull())
        .select(*keys, "x.kind", "x.start_us", F.when(F.col("x.end_us") == OPEN_US, -1).otherwise(F.col("x.end_us")).alias("end_us"))
    )


def edge_periods(edges: DataFrame, agents: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Periods and gaps of temporal edges per folded ``from_id`` and relation, whatever ``to_id``."""
    return periods_and_gaps(temporal_intervals(edges, agents), ["entity_key", "relation_key"], target_rows)
