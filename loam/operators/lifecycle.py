"""Tiers, decay, compaction, health, digests and snapshots of notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import front_block, front_matter, lines
from loam.plans.ordered import TARGET_ROWS, bucketed
from loam.session import cut

#: Cues of each memory type, tested in this order, and how fast each type decays.
MEMORY_TYPES = {
    "identity": ["i am", "my name", "i'm", "내 이름", "나는", "저는", "identity", "core"],
    "belief": ["believe", "value", "principle", "conviction", "philosophy", "신념", "가치", "원칙"],
    "preference": ["prefer", "like", "favorite", "hate", "dislike", "좋아", "싫어", "선호"],
    "relationship": ["friend", "colleague", "partner", "team", "동료", "친구", "팀"],
    "skill": ["how to", "procedure", "workflow", "방법", "절차", "워크플로우"],
    "routine": ["daily", "routine", "every day", "always", "usually", "매일", "항상", "일상"],
    "transient": ["today", "tonight", "right now", "currently", "오늘", "지금", "현재"],
}
DECAY = {"identity": 0.1, "belief": 0.2, "preference": 0.3, "relationship": 0.3, "skill": 0.4, "routine": 0.9, "transient": 1.0, "default": 0.5}


def first_of(text: Column, cues: dict[str, list[str]], default: str) -> Column:
    """First class one of whose cues the lower-cased text contains."""
    out = None
    for name, words in cues.items():
        met = F.lit(False)
        for w in words:
            met = met | F.lower(text).contains(w)
        out = F.when(met, name) if out is None else out.when(met, name)
    return out.otherwise(default)


def memory_type(text: Column) -> Column:
    return first_of(text, MEMORY_TYPES, "default")


def decay_rate(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in DECAY.items() for x in kv])[kind]


def with_meta(docs: DataFrame, as_of: str) -> DataFrame:
    """Add ``tier`` (front matter, default recall), ``size`` in characters and ``age`` in days; ages of notes from
    after ``as_of`` are negative."""
    tier = F.regexp_extract(front_block(F.col("content")), r"(?m)^tier: *([a-z]+)", 1)
    age = F.datediff(F.lit(as_of).cast("date"), F.col("mtime").cast("date"))
    known = F.when(tier.isin("core", "recall", "archival"), tier).otherwise("recall")
    return docs.withColumn("tier", known).withColumn("size", F.length("content").cast("long")).withColumn("age", age)


def timeline(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, event_date, text, source`` of timeline bullets ``- **date** | text [Source: s]``."""
    rows = docs.select("doc_id", F.posexplode(lines(F.col("content"))).alias("line_no", "line"))
    bullet = r"^- \*\*(\d{4}-\d{2}-\d{2})\*\* \| (.*?)(?: \[Source: ([^\]]*)\])?\s*$"
    parsed = rows.where(F.col("line").rlike(r"^- \*\*\d{4}-\d{2}-\d{2}\*\* \| "))
    return parsed.select("doc_id", "line_no", *[F.regexp_extract("line", bullet, i + 1).alias(n) for i, n in enumerate(("event_date", "text", "source"))])


def fact_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, key, value, vf, vt, recorded`` of fact lines; an open end is null."""
    rows = docs.select("doc_id", F.explode(lines(F.col("content"))).alias("line"))
    p = r"^- ([^:\n]+): (.*?) *<!-- valid:\[([^.\]]*)\.\.([^\]\)]*)[\]\)] recorded:([^ ]+) -->"
    cols = [F.regexp_extract("line", p, i + 1).alias(n) for i, n in enumerate(("key", "value", "vf", "vt", "recorded"))]
    out = rows.where(F.col("line").rlike(p)).select("doc_id", *cols)
    return out.withColumn("vt", F.nullif("vt", F.lit("")))


def flagged_for_decay(docs: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Timeline lines older than ``days`` divided by their type's rate (0.05 at least)."""
    rows = timeline(docs).withColumn("memory_type", memory_type(F.col("text")))
    age = F.datediff(F.lit(as_of).cast("date"), F.col("event_date").try_cast("date"))
    limit = F.floor(F.lit(float(days)) / F.greatest(decay_rate(F.col("memory_type")), F.lit(0.05)))
    return rows.select("doc_id", "line_no", "memory_type", age.alias("age")).where(F.col("age") > limit)


def auto_tier(meta: DataFrame, uses: DataFrame, core: float = 0.7, archival: float = 0.25) -> DataFrame:
    """``doc_id, tier, new_tier, score``: 0.4 recency (halved every 180 days), 0.3 frequency of use, 0.3 importance of
    the old tier."""
    rows = meta.join(uses, "doc_id", "left")
    recency = F.pow(F.lit(0.5), F.greatest(F.col("age"), F.lit(0)) / 180.0)
    frequency = F.least(F.lit(1.0), F.coalesce("n_uses", F.lit(0)) / 20.0)
    importance = F.when(F.col("tier") == "core", 1.0).when(F.col("tier") == "recall", 0.5).otherwise(0.1)
    score = F.floor((0.4 * recency + 0.3 * frequency + 0.3 * importance) * 10_000 + F.lit(0.5)) / F.lit(10_000.0)
    new = F.when(score >= core, "core").when(score >= archival, "recall").otherwise("archival")
    return rows.select("doc_id", "tier", new.alias("new_tier"), score.alias("score"))


def tier_report(meta: DataFrame) -> DataFrame:
    return meta.groupBy("dir", "tier").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("n_chars"), F.min("age").alias("youngest"), F.max("age").alias("oldest"))


def working_set(meta: DataFrame, limit: int = 50) -> DataFrame:
    """Core notes, then recall notes, newest first, up to ``limit``."""
    rank = F.when(F.col("tier") == "core", 0).otherwise(1)
    rows = meta.where("tier in ('core', 'recall')").select("doc_id", "tier", "mtime", rank.alias("rank"))
    return rows.orderBy("rank", F.desc("mtime"), "doc_id").limit(limit).select("doc_id", "tier")


def compacted(meta: DataFrame, max_chars: int, target_rows: int = TARGET_ROWS) -> DataFrame:
    """``doc_id, reason``: live notes to archive.  ``age``: over 90 days and not core.  ``budget``: recall notes over
    30 days, oldest first, while what is left of the memory exceeds ``max_chars``.

    What is left before a note is the total less all candidates before it: removals for the budget form a prefix,
    so a running total over the notes by age replaces a loop.  The whole table is one key; it is cut into buckets.
    """
    live = meta.where("dir = 'live-notes' and tier != 'archival'")
    by_age = (F.col("age") > 90) & (F.col("tier") != "core")
    by_budget = (F.col("age") > 30) & (F.col("tier") == "recall")
    total = meta.agg(F.sum("size")).first()[0] or 0
    rows = live.select("doc_id", "mtime", F.when(by_age, "age").when(by_budget, "budget").alias("reason"), "size").where("reason is not null")
    rows = cut(rows.withColumn("one", F.lit(0)).withColumn("at", F.struct("mtime", "doc_id")))
    run = bucketed(rows, ["one"], "at", target_rows).running_total("size", "upto", "_c_all").df
    left = F.lit(total) - (F.col("upto") - F.col("size"))
    return run.where((F.col("reason") == "age") | (left > max_chars)).select("doc_id", "reason")


def freshness(meta: DataFrame) -> DataFrame:
    """Documents per directory by age: a week, a month, older."""
    n = lambda c: F.count(F.when(c, 1))
    return meta.groupBy("dir").agg(n(F.col("age") <= 7).alias("week"), n((F.col("age") > 7) & (F.col("age") <= 30)).alias("month"), n(F.col("age") > 30).alias("older"))


def checks(meta: DataFrame, as_of_hours: int = 48) -> DataFrame:
    """``check, n_bad, n_docs``: notes without source mark, thin, bloated, without confidence, and old inbox items."""
    c = F.col("content")
    bad = {
        "no_source": ~c.contains("[Source:") & ~c.contains("source:"),
        "thin": F.col("size") < 300,
        "bloated": F.col("size") > 4000,
        "no_confidence": ~F.lower(c).contains("confidence:"),
        "stale_inbox": (F.col("dir") == "inbox") & (F.col("age") * 24 > as_of_hours),
    }
    sums = meta.agg(F.count(F.lit(1)).alias("n_docs"), *[F.count(F.when(v, 1)).alias(k) for k, v in bad.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("n_bad")) for k in bad])
    return sums.select("n_docs", F.inline(rows)).select("check", "n_bad", "n_docs")


def digest(meta: DataFrame, as_of: str, max_chars: int = 4000) -> DataFrame:
    """``doc_id, tier, pos``: core notes, then recall notes of the last 30 days, whose stems fit the budget; the
    candidates are cut to ``max_chars`` rows before they are summed, as each takes a character at least."""
    rows = meta.where((F.col("tier") == "core") | ((F.col("tier") == "recall") & (F.col("age") <= 30)))
    rows = rows.select("doc_id", "tier", "mtime", F.when(F.col("tier") == "core", 0).otherwise(1).alias("rank"), (F.length("stem") + 1).alias("n"))
    first = rows.orderBy("rank", F.desc("mtime"), "doc_id").limit(max_chars)
    w = Window.orderBy("rank", F.desc("mtime"), "doc_id")
    run = first.select("doc_id", "tier", F.row_number().over(w).alias("pos"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("used"))
    return run.where(F.col("used") <= max_chars).select("doc_id", "tier", "pos")


def index(docs: DataFrame) -> DataFrame:
    """``doc_id, summary, headings, n_headings``: first meaningful line and up to 20 headings."""
    all_lines = lines(F.col("content"))
    heads = F.filter(all_lines, lambda x: x.startswith("#"))
    body = F.filter(all_lines, lambda x: (F.length(x) > 10) & ~x.rlike("^(?:#|---|tier:|tags:|source:|updated:|confidence:|>|\\||```)"))
    return docs.select("doc_id", F.substring(F.coalesce(F.get(body, F.lit(0)), F.lit("")), 1, 200).alias("summary"), F.array_join(F.slice(heads, 1, 20), "|").alias("headings"), F.size(heads).alias("n_headings"))


def snapshot(docs: DataFrame, name: str) -> DataFrame:
    """``snapshot, path, size, hash`` of every document: twelve hex digits of its SHA-256."""
    return docs.select(F.lit(name).alias("snapshot"), "path", F.length("content").alias("size"), F.substring(F.sha2(F.encode("content", "UTF-8"), 256), 1, 12).alias("hash"))


def snapshot_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """``path, state, delta``: added, removed, modified or unchanged, by a full outer join on the path."""
    x = a.select("path", F.col("hash").alias("ha"), F.col("size").alias("sa"))
    y = b.select("path", F.col("hash").alias("hb"), F.col("size").alias("sb"))
    state = F.when(F.col("ha").isNull(), "added").when(F.col("hb").isNull(), "removed").when(F.col("ha") != F.col("hb"), "modified").otherwise("unchanged")
    return x.join(y, "path", "full").select("path", state.alias("state"), (F.coalesce("sb", F.lit(0)) - F.coalesce("sa", F.lit(0))).alias("delta"))


def snapshot_history(snapshots: DataFrame, names: list[str]) -> DataFrame:
    """``path, states``: per path its state in each snapshot of ``names`` in order (new, modified, unchanged, deleted,
    absent); a pivot with fixed columns, combined before the shuffle."""
    cols = [F.max(F.when(F.col("snapshot") == n, F.col("hash"))).alias(f"h{i}") for i, n in enumerate(names)]
    wide = snapshots.groupBy("path").agg(*cols)
    states = []
    for i in range(len(names)):
        now, before = F.col(f"h{i}"), F.col(f"h{i - 1}") if i else F.lit(None).cast("string")
        states.append(F.when(now.isNull() & before.isNull(), "absent").when(now.isNull(), "deleted").when(before.isNull(), "new").when(now == before, "unchanged").otherwise("modified"))
    return wide.select("path", F.concat_ws(",", *states).alias("states"))


def meta_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, key, value`` of front matter."""
    return docs.select("doc_id", F.explode(front_matter(F.col("content"))).alias("key", "value"))
