"""Append-only logs and their views: what tasks, channels, agents, incidents, decisions, aliases and tiers are made of.

A log has ``store, id, at, seq, action, field, value``: ``set`` replaces a field, ``add`` appends a member to a list
field, ``unset`` takes a field away, ``drop`` ends the id until something is set again.  Nothing is updated in place, so
every write is an append and every read a combinable maximum: hot ids are reduced before the shuffle, and lists stay rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ["store", "id", "at", "seq", "action", "field", "value"]


def entries(df: DataFrame, store: str, key: Column, at: Column, seq: Column, fields: dict[str, Column], action: str = "set") -> DataFrame:
    """Rows of a table as log entries: one ``action`` per field whose value isn't null; rows without key are skipped."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), v.cast("string").alias("value")) for f, v in fields.items()])
    told = df.select(F.lit(store).alias("store"), key.cast("string").alias("id"), at.cast("timestamp").alias("at"), seq.cast("long").alias("seq"), F.lit(action).alias("action"), F.inline(rows))
    return told.where("id is not null and value is not null").select(*COLUMNS)


def _order() -> Column:
    # an entry without a time is the earliest; of one time the larger number counts
    return F.struct(F.coalesce(F.unix_micros("at"), F.lit(-(1 << 62))).alias("t"), F.coalesce("seq", F.lit(-1)).alias("s"))


def fields_of(log: DataFrame, as_of: str | None = None) -> DataFrame:
    """``store, id, field, value, at``: what holds (at ``as_of``): of each field the last entry, if that sets it, and if
    the id was not dropped since."""
    rows = log if as_of is None else log.where(F.col("at") <= F.lit(as_of).cast("timestamp"))
    drops = rows.where("action = 'drop'").groupBy("store", "id").agg(F.max(_order()).alias("ended"))
    last = rows.where("action in ('set', 'unset')").groupBy("store", "id", "field").agg(F.max(F.struct(_order().alias("o"), "action", "value", "at")).alias("b"))
    kept = last.where("b.action = 'set'").join(drops, ["store", "id"], "left").where("ended is null or b.o > ended")
    return kept.select("store", "id", "field", "b.value", "b.at")


def records(log: DataFrame, store: str, fields: list[str], as_of: str | None = None) -> DataFrame:
    """``id`` and one column per field of what holds in a store; fixed columns, combined before the shuffle."""
    held = fields_of(log.where(F.col("store") == store), as_of)
    return held.groupBy("id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])


def members(log: DataFrame, store: str, field: str) -> DataFrame:
    """``id, value, n, first_at``: distinct members of a list field, never collected into one row."""
    own = log.where((F.col("store") == store) & (F.col("field") == field) & (F.col("action") == "add"))
    return own.groupBy("id", "value").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))


def history(log: DataFrame, store: str, key: str | None = None) -> DataFrame:
    """``id, at, seq, action, field, value`` of a store (of one id); the order is the reader's, rows carry it."""
    rows = log.where(F.col("store") == store)
    return (rows if key is None else rows.where(F.col("id") == key)).drop("store")


def newest(found: DataFrame, by: str, limit: int, where: Column | None = None) -> DataFrame:
    """The ``limit`` records with the latest ``by`` (ties: smallest id)."""
    kept = found if where is None else found.where(where)
    return kept.orderBy(F.desc_nulls_last(by), "id").limit(limit)


def appended(log: DataFrame, more: DataFrame) -> DataFrame:
    """The log with entries that it doesn't hold yet: an append of the same entries twice changes nothing."""
    return log.select(*COLUMNS).unionByName(more.select(*COLUMNS).subtract(log.select(*COLUMNS)))


def handed_over(log: DataFrame, store: str, old: str, new: str, at: str) -> DataFrame:
    """Entries that give ``new`` what ``old`` holds at ``at``, and say from whom."""
    held = fields_of(log.where((F.col("store") == store) & (F.col("id") == old)), at)
    moved = held.select("store", F.lit(new).alias("id"), F.lit(at).cast("timestamp").alias("at"), F.lit(0).cast("long").alias("seq"), F.lit("set").alias("action"), "field", "value")
    told = moved.limit(1).withColumns({"field": F.lit("handed_from"), "value": F.lit(old)})
    return moved.unionByName(told).select(*COLUMNS)


# --- decay, as a view of uses --------------------------------------------------------------------------------------


def decayed(uses: DataFrame, as_of: str, rate: float = 0.5, days: int = 30) -> DataFrame:
    """``id, weight, n_decays, dead``: a weight of 1 that shrinks by ``rate`` for each full period of ``days`` since the last
    use (``id, at, dead``), six decimals; the dead keep weight 0.

    A use restores the weight, so only the last one counts.  An id without any time counts as never decayed.
    """
    last = uses.where("id is not null").groupBy("id").agg(F.max("at").alias("at"), F.max(F.coalesce("dead", F.lit(False))).alias("dead"))
    n = F.greatest(F.lit(0), F.floor(F.coalesce(F.datediff(F.lit(as_of).cast("date"), F.col("at").cast("date")), F.lit(0)) / days))
    weight = F.floor(F.pow(F.lit(1.0 - rate), n) * 1_000_000 + F.lit(0.5)) / F.lit(1_000_000.0)
    return last.select("id", F.when(F.col("dead"), 0.0).otherwise(weight).alias("weight"), n.cast("long").alias("n_decays"), "dead")


def decay_candidates(weights: DataFrame, uses: DataFrame, above: float, fewer: int) -> DataFrame:
    """``id, weight, n_uses``: the living with a weight above ``above`` and fewer than ``fewer`` uses."""
    n = uses.where("id is not null").groupBy("id").agg(F.count("at").alias("n_uses"))
    return weights.where(~F.col("dead") & (F.col("weight") > above)).join(n, "id").where(F.col("n_uses") < fewer).select("id", "weight", "n_uses")


TIERS = ["archival", "recall", "core"]


def moved_tier(tier: Column, by: int) -> Column:
    """The tier ``by`` steps up or down, within the three there are; unknown ones count as recall."""
    at = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier), F.lit(0))
    at = F.when(at == 0, 2).otherwise(at)
    return F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.least(F.lit(3), F.greatest(F.lit(1), at + by)).cast("int"))


def ranked_within(df: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key; the limit is applied per task before the shuffle."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("pos") <= most)
