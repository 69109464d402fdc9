"""Bitemporal facts: as-of views and joins, stale closing, deduplication, observations and contradictions.

Dates are ISO strings compared as such; a missing bound is open.  Every per-key choice is a combinable maximum, so
hot keys are reduced before the shuffle; ordered computations go through ``loam.plans.ordered``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.plans.ordered import TARGET_ROWS, bucketed
from loam.session import cut

LOW, HIGH = "0000", "9999"

#: Beginnings of keys, and values, of negative preferences.
NEGATIVE_KEYS = ["dislike", "not_", "avoid", "discontinued", "persona_dislike", "hate", "anti"]
NEGATIVE_VALUES = ["no", "none", "never", "n/a", "false"]


def bound(value: Column) -> Column:
    """A date bound; ``now``, ``none``, ``null`` and blank are open (null)."""
    v = F.trim(value)
    return F.when(~F.lower(v).isin("", "now", "none", "null"), v)


def facts_view(facts: DataFrame) -> DataFrame:
    """``entity, key, value, vf, vt, recorded, fact_type, line_no`` with open bounds as null; null keys are skipped."""
    return facts.where("entity is not null and key is not null").select(
        "entity", "key", "value", bound(F.col("valid_from")).alias("vf"), bound(F.col("valid_to")).alias("vt"),
        F.coalesce(bound(F.col("recorded_at")), F.lit("")).alias("recorded"), F.coalesce("fact_type", F.lit("episodic")).alias("fact_type"), F.coalesce("line_no", F.lit(0)).alias("line_no"),
    )


def valid_at(day: str) -> Column:
    return (F.col("vf").isNull() | (F.col("vf") <= day)) & (F.col("vt").isNull() | (F.col("vt") >= day))


def _newest(*more: str) -> Column:
    return F.struct("recorded", (-F.col("line_no")).alias("back"), F.coalesce("value", F.lit("")).alias("v"), *more)


def fact_at(view: DataFrame, day: str) -> DataFrame:
    """``entity, key, value`` valid on ``day``; the latest recorded wins, then the first line."""
    best = view.where(valid_at(day)).groupBy("entity", "key").agg(F.max(_newest("value")).alias("b"))
    return best.select("entity", "key", "b.value")


def history(view: DataFrame, entity: str) -> DataFrame:
    """All facts of an entity by time of recording (a range sort, not a window)."""
    rows = view.where(F.col("entity") == entity)
    return rows.orderBy("key", "recorded", F.coalesce("vf", F.lit("")), "line_no").select("key", "value", "vf", "vt", "recorded", "line_no")


def close_stale(view: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """``entity, key, value, vf, line_no, closed_to``: open facts that a later start of the same key closes."""
    starts = cut(view.where("vf is not null").select("entity", "key", "vf").distinct())
    following = bucketed(starts, ["entity", "key"], "vf", target_rows).neighbours({}, {"closed_to": "vf"}).df.where("closed_to is not null")
    opened = view.where("vt is null and vf is not null")
    return opened.join(following.select("entity", "key", "vf", "closed_to"), ["entity", "key", "vf"]).select("entity", "key", "value", "vf", "line_no", "closed_to")


def invalidate(view: DataFrame, key: str, day: str) -> DataFrame:
    """Facts after every open one of ``key`` was closed on ``day``."""
    closing = (F.col("key") == key) & F.col("vt").isNull()
    return view.select("entity", "key", "value", "vf", F.when(closing, day).otherwise(F.col("vt")).alias("vt"), "line_no", closing.alias("closed"))


def keys_of(view: DataFrame) -> DataFrame:
    """Per entity its sorted distinct keys, as one string; as long as the vocabulary of keys at most."""
    return view.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("keys"), F.countDistinct("key").alias("n_keys"))


def deduplicated(view: DataFrame) -> DataFrame:
    """One row per entity, key and value: an open one first, then the latest recorded; and how many there were."""
    best = F.max(F.struct(F.col("vt").isNull().cast("int").alias("open"), "recorded", (-F.col("line_no")).alias("back"), F.coalesce("vf", F.lit("")).alias("f"), "vf", "vt", "line_no")).alias("b")
    rows = view.groupBy("entity", "key", "value").agg(best, F.count(F.lit(1)).alias("n_copies"))
    return rows.select("entity", "key", "value", "b.vf", "b.vt", "b.line_no", "n_copies")


def stale(view: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    """Open facts whose start is at least ``days`` old; a start that is no date is not stale."""
    age = F.datediff(F.lit(as_of).cast("date"), F.substring("vf", 1, 10).try_cast("date"))
    return view.where(F.col("vt").isNull()).select("entity", "key", "value", "vf", "line_no", age.alias("age")).where(F.col("age") >= days)


def observations(view: DataFrame, day: str, most: int = 5) -> DataFrame:
    """Per entity its first ``most`` keys with the value that counts on ``day``: ``k=v; k=v``.

    The row-number limit is applied per task before the shuffle, so no more than ``most`` rows are collected.
    """
    w = Window.partitionBy("entity").orderBy("pair")
    pairs = fact_at(view, day).where("value is not null").select("entity", F.concat_ws("=", "key", "value").alias("pair"))
    first = pairs.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most)
    return first.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_list("pair")), "; ").alias("observation"))


def overlap_counts(df: DataFrame, keys: list[str], target_rows: int = TARGET_ROWS) -> DataFrame:
    """Per row of ``df`` (``keys, row, a, b``) how many rows of its keys overlap ``[a, b]``, itself included.

    Overlapping are all that start by ``b`` less those that end before ``a``; both come from running totals over
    distinct bounds, so no pairs are made.
    """
    sides = F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("s"), F.lit(0).alias("e")), F.struct(F.col("b").alias("at"), F.lit(0).alias("s"), F.lit(1).alias("e")))
    points = cut(df.select(*keys, F.inline(sides)).groupBy(*keys, "at").agg(F.sum("s").alias("s"), F.sum("e").alias("e")))
    run = bucketed(points, keys, "at", target_rows).running_total("s", "started", "_s_all").running_total("e", "ended", "_e_all").df
    run = run.select(*keys, "at", "started", (F.col("ended") - F.col("e")).alias("gone"))
    by_b = run.select(*keys, F.col("at").alias("b"), "started")
    by_a = run.select(*keys, F.col("at").alias("a"), "gone")
    return df.join(by_b, [*keys, "b"]).join(by_a, [*keys, "a"]).select(*keys, "row", (F.col("started") - F.col("gone")).alias("n"))


def contradictions(view: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """``entity, key, value, vf, vt, line_no, n_conflicts``: facts that overlap facts of the same key with other values.

    One row per distinct fact with the number of its conflicts; no pairs are made.  Inverted intervals take no part.
    """
    kept = view.where("value is not null").select("entity", "key", "value", "vf", "vt", "line_no").distinct()
    ends = kept.withColumn("a", F.coalesce("vf", F.lit(LOW))).withColumn("b", F.coalesce("vt", F.lit(HIGH))).where("a <= b")
    rows = cut(ends.withColumn("row", F.monotonically_increasing_id()))
    every = overlap_counts(rows, ["entity", "key"], target_rows).select("row", F.col("n").alias("n_all"))
    same = overlap_counts(rows, ["entity", "key", "value"], target_rows).select("row", F.col("n").alias("n_same"))
    told = rows.join(every, "row").join(same, "row").withColumn("n_conflicts", F.col("n_all") - F.col("n_same"))
    return told.where("n_conflicts > 0").select("entity", "key", "value", "vf", "vt", "line_no", "n_conflicts")


def conflicting_keys(view: DataFrame) -> DataFrame:
    """Keys of an entity with several values, their number, and the current one (latest start, then recorded)."""
    latest = F.max(F.struct(F.coalesce("vf", F.lit("")).alias("f"), "recorded", (-F.col("line_no")).alias("back"), "value")).alias("b")
    rows = view.where("value is not null").groupBy("entity", "key").agg(F.countDistinct("value").alias("n_values"), latest)
    return rows.where("n_values > 1").select("entity", "key", "n_values", F.col("b.value").alias("current"))


def preference_context(view: DataFrame, day: str, relevant: list[str], most: int = 3) -> DataFrame:
    """Per entity the ``most`` preferences of highest weight on ``day``: 1.0 for relevant keys, 0.3 for others.

    The row-number limit is applied per task before the shuffle, so a hot entity sends few rows.
    """
    now = fact_at(view, day).where("value is not null")
    weight = F.when(F.col("key").isin(relevant), 1.0).otherwise(0.3)
    w = Window.partitionBy("entity").orderBy(F.desc("weight"), "key")
    return now.withColumn("weight", weight).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most)


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, row: str, value: str, target_rows: int = TARGET_ROWS) -> DataFrame:
    """``keys, row, at, value``: for each left row the value of the last right row of its keys that began by ``at``.

    Both sides are laid on one time line and the last value is carried along it, so neither side is multiplied and
    hot keys are cut into time buckets.  Right rows with one start are reduced to the largest value; left rows
    without a match have null.
    """
    begins = right.groupBy(*keys, F.col(since).alias("t")).agg(F.max(value).alias("v")).select(*keys, "t", F.lit(0).alias("side"), F.lit(None).cast("long").alias("r"), "v")
    asks = left.select(*keys, F.col(at).alias("t"), F.lit(1).alias("side"), F.col(row).cast("long").alias("r"), F.lit(None).cast("string").alias("v"))
    line = cut(begins.unionByName(asks).where(F.col("t").isNotNull()).withColumn("o", F.struct("t", "side", "r")))
    told = bucketed(line, keys, "o", target_rows).carried("v", "carried").df
    return told.where("side = 1").select(*keys, F.col("r").alias(row), F.col("t").alias(at), F.col("carried").alias(value))


def chain(view: DataFrame, start: str, end: str) -> DataFrame:
    """Facts that began in a window, newest best: ``0.3 + 0.7 * (1 - age / span)`` with the age in days."""
    day = F.substring("vf", 1, 10).try_cast("date")
    rows = view.where(F.col("vf").between(start, end)).select("entity", "key", "value", "vf", "line_no", F.datediff(F.lit(end).cast("date"), day).alias("age")).where("age is not null")
    top = rows.agg(F.greatest(F.lit(1), F.max("age")).alias("span")).first()["span"]
    return rows.select("entity", "key", "value", "vf", "line_no", (F.lit(0.3) + 0.7 * (1 - F.col("age") / F.lit(float(top or 1)))).alias("score"))


def clean_value(value: Column) -> Column:
    """Whether a value is a short phrase: 60 characters, eight words, one period and one comma at most."""
    v = F.trim(value)
    count = lambda mark: F.length(v) - F.length(F.translate(v, mark, ""))
    return (v != "") & (F.length(v) <= 60) & (F.size(F.split(v, r"\s+")) <= 8) & (count(".") < 2) & (count(",") < 2)


def negative_preference(key: Column, value: Column) -> Column:
    met = F.lower(F.trim(value)).isin(NEGATIVE_VALUES)
    for p in NEGATIVE_KEYS:
        met = met | F.lower(key).startswith(p)
    return met


def preference_edges(view: DataFrame, keys: list[str]) -> DataFrame:
    """Edges that preferences stand for: entity to value by polarity, and value to its category; negative ones only of short
    phrases, as a long sentence is no thing to dislike."""
    negative = negative_preference(F.col("key"), F.col("value"))
    rows = view.where(F.col("key").isin(keys) & F.col("value").isNotNull() & (~negative | clean_value(F.col("value"))))
    rows = rows.select("entity", "key", "value", F.when(negative, "dislikes").otherwise("prefers").alias("verb")).distinct()
    edge = lambda a, r, b: F.struct(a.alias("from_id"), r.alias("relation"), b.alias("to_id"))
    e = F.array(edge(F.col("entity"), F.col("verb"), F.lower("value")), edge(F.lower("value"), F.lit("category"), F.col("key")))
    return rows.select(F.inline(e)).distinct()
