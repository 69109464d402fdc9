"""Full history of changing attributes: every version and when it was valid (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.fold import fold, not_blank
from loam.operators.instants import edge_instant
from loam.operators.intervals import OPEN_US, temporal_intervals
from loam.plans.ordered import TARGET_ROWS, bucketed
from loam.session import cut

#: Relations whose ``to_id`` is an attribute of ``from_id``, in folded form.
ATTRIBUTES = ["livesin", "worksat", "reportsto", "holdsrole"]


def versions(states: DataFrame, keys: list[str], target_rows: int = TARGET_ROWS) -> DataFrame:
    """Versions of ``value_key`` per ``keys``.

    ``states`` has ``keys, value_key, from_us, until_us`` with one row per key and start.  A state lasts until its
    own end or the next start; a change of the value's hash (checked against the value itself) or a hole begins a
    new island, a running sum numbers them, and each island gives one row.
    """
    states = states.withColumn("_hash", F.xxhash64("value_key"))
    b = bucketed(states, keys, "from_us", target_rows).neighbours({"_hash0": "_hash", "_value0": "value_key", "_until0": "until_us"}, {"_next": "from_us"})
    df = (
        b.df.withColumn("_end", F.least("until_us", F.coalesce("_next", F.lit(OPEN_US))))
        .withColumn("_end0", F.least("_until0", "from_us"))
        .withColumn("_new", F.when((F.col("_hash0") == F.col("_hash")) & (F.col("_value0") == F.col("value_key")) & (F.col("_end0") == F.col("from_us")), 0).otherwise(1))
    )
    islands = b._with(df).running_total("_new", "_island", "_islands").df
    return (
        islands.groupBy(*keys, "_island")
        .agg(F.min("value_key").alias("value_key"), F.min("from_us").alias("from_us"), F.max("_end").alias("until_us"))
        .select(*keys, "value_key", "from_us", F.when(F.col("until_us") == OPEN_US, -1).otherwise(F.col("until_us")).alias("until_us"))
    )


def attribute_states(edges: DataFrame, agents: DataFrame) -> DataFrame:
    """The row that counts for each folded ``from_id``, relation and start: latest created, then largest id.

    A row without a creation instant is the earliest.  Chosen by a combinable maximum, so a hot key is reduced
    before the shuffle.
    """
    rows = temporal_intervals(edges, agents).where(F.col("relation_key").isin(ATTRIBUTES) & not_blank(F.col("to_id")))
    ranked = rows.select(
        "entity_key",
        "relation_key",
        F.col("start_us").alias("from_us"),
        F.struct(
            F.coalesce(edge_instant("created_at"), F.lit(-(2**63))).alias("created"),
            F.col("id"),
            fold(F.col("to_id")).alias("value_key"),
            F.col("end_us").alias("until_us"),
        ).alias("s"),
    )
    best = ranked.groupBy("entity_key", "relation_key", "from_us").agg(F.max("s").alias("s"))
    return best.select("entity_key", "relation_key", "from_us", "s.value_key", "s.until_us")


def edge_history(edges: DataFrame, agents: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """``(entity_key, relation_key, value_key, from_us, until_us)`` of all versions; -1 is an open end."""
    return versions(cut(attribute_states(edges, agents)), ["entity_key", "relation_key"], target_rows)
