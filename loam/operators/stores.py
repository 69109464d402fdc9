"""Entities, sections, incidents, runbooks, tasks and prompts as views over append-only logs."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Hashable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import jaccard, lines, tokens, tokens_of
from loam.operators.extract import condition_bonus
from loam.operators.lexical import similarity
from loam.operators.lifecycle import decay_rate, memory_type
from loam.plans.ordered import TARGET_ROWS, bucketed
from loam.session import cut

#: Pairs of wordings that contradict each other.
OPPOSED = [("is ", "is not "), ("is ", "isn't "), ("was ", "was not "), ("was ", "wasn't "), ("can ", "cannot "), ("can ", "can't "), ("will ", "will not "), ("will ", "won't "), ("이다", "아니다"), ("맞다", "틀리다"), ("맞다", "아니다"), ("true", "false"), ("yes", "no"), ("active", "inactive"), ("open", "closed"), ("joined", "left"), ("started", "stopped"), ("accepted", "rejected"), ("approved", "denied")]
#: Words that begin no name.
COMMON = [
    "The", "This", "That", "And", "But", "For", "Not", "All", "Has", "Was", "Are", "Its", "Our", "Their", "Yc", "From", "With", "Please", "Contact", "However",
    "While", "These", "Those", "Each", "Some", "Many", "Other", "Such", "Most", "Last", "New", "Old", "Next", "Here", "After", "Before", "Between", "Under",
    "Over", "Every", "About", "Also", "Just", "When", "Where", "Why", "How", "What", "Who", "Which", "More", "Much", "Very", "Well", "Still", "Even", "Back",
    "Down", "Only", "Then", "Than", "Both", "Into", "Like", "Made", "Come", "Could", "Would", "Should", "Will", "May", "Can", "Did", "Does",
]
#: Further words that begin sentences of notes.
OPENERS = ["Nobody", "Someone", "Open", "Ask", "Remember", "Confidence", "Nothing", "Meeting"]
#: Patterns of named things.
PERSON = r"[A-Z][a-z]+(?: [A-Z][a-z]+){1,2}"
ENTITY_PATTERNS = {
    "organization": r"(?:[A-Z][a-z]+ )+(?:Incorporated|Corporation|Limited|Company|GmbH|Partners|Brothers|Foundation|Institute|Holdings)",
    "handle": r"@[A-Za-z][A-Za-z0-9_]{1,30}",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "url": r"https?://[A-Za-z0-9./?=_%&#-]+",
}
#: Endings of files by what they hold; any other is binary.
MODALITIES = {
    "image": ["jpg", "jpeg", "png", "gif", "webp", "bmp", "tiff", "heic", "svg"],
    "audio": ["mp3", "wav", "m4a", "flac", "ogg", "aac", "opus"],
    "video": ["mp4", "mov", "mkv", "avi", "webm"],
    "code": [
        "py", "js", "ts", "tsx", "jsx", "rs", "go", "java", "c", "cc", "cpp", "h", "hpp", "rb", "php", "swift", "kt", "scala", "sh", "bash", "zsh", "lua",
        "pl", "r", "sql", "html", "css", "scss", "vue", "svelte", "dart", "ex", "exs", "clj", "hs", "toml", "yaml", "yml", "json", "xml", "ini", "cfg",
    ],
    "text": ["txt", "md", "rst", "log", "csv", "tsv"],
}


def detected(docs: DataFrame) -> DataFrame:
    """``doc_id, kind, name``: named things of a document; a person's name that begins with a common word is none.  One scan
    for all patterns."""
    found = F.array_distinct(F.flatten(F.array(*[_kinds(k, p) for k, p in {"person": PERSON, **ENTITY_PATTERNS}.items()])))
    rows = docs.select("doc_id", F.explode(found).alias("e")).select("doc_id", "e.kind", "e.name")
    return rows.where((F.col("kind") != "person") | ~F.split("name", " ")[0].isin(COMMON + OPENERS))


def _kinds(kind: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))


def opposing(old: Column, new: Column) -> Column:
    """Whether two lower-case facts contradict each other: an opposed pair of wordings, or one field with two values."""
    met = F.lit(False)
    for a, b in OPPOSED:
        met = met | (old.contains(a) & new.contains(b)) | (old.contains(b) & new.contains(a))
    field = r"([\p{L}\p{N}_]+):\s*(.+)$"
    same = (F.regexp_extract(old, field, 1) != "") & (F.regexp_extract(old, field, 1) == F.regexp_extract(new, field, 1))
    return met | (same & (F.trim(F.regexp_extract(old, field, 2)) != F.trim(F.regexp_extract(new, field, 2))))


def state_changes(view: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """``entity, key, vf, old, new``: starts at which the value of a key changes; of one start the last value counts."""
    states = cut(view.where("vf is not null and value is not null").groupBy("entity", "key", "vf").agg(F.max("value").alias("value")))
    rows = bucketed(states, ["entity", "key"], "vf", target_rows).neighbours({"old": "value"}, {}).df
    return rows.where("old is not null and old != value").select("entity", "key", "vf", "old", F.col("value").alias("new"))


def resolved(view: DataFrame, strategy: str = "newest") -> DataFrame:
    """``entity, key, value``: the fact that wins a conflict, the ``newest`` or the most trusted (``confidence``: verified,
    experimental, hypothesis, none, as the value says), of equals the newest."""
    said = F.regexp_extract(F.lower("value"), "(verified|experimental|hypothesis)", 1)
    trust = F.when(said == "verified", 3).when(said == "experimental", 2).when(said == "hypothesis", 1).otherwise(0)
    order = [F.col("recorded"), (-F.col("line_no")).alias("back"), F.col("value")]
    order = [trust.alias("trust"), *order] if strategy == "confidence" else order
    return view.where("value is not null").groupBy("entity", "key").agg(F.max(F.struct(*order)).alias("b")).select("entity", "key", "b.value")


def sections(docs: DataFrame) -> DataFrame:
    """``doc_id, section, route, n_items``: sections of a note, where their bullets go, and how many there are.

    The window runs over the lines of one document, which bounds it.
    """
    rows = docs.select("doc_id", F.posexplode(lines(F.col("content"))).alias("line_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("line").startswith("## "), F.trim(F.regexp_replace("line", "^## +|\r", "")))
    told = rows.withColumn("section", F.coalesce(F.last(head, ignorenulls=True).over(w), F.lit("")))
    low = F.lower("section")
    route = F.when(low.rlike("timeline|progress|연표|chronologie"), "events").when(low.rlike("open points|next|할 일|questions|schritte"), "tasks").when(low.rlike("why|how|outcome|결과|ergebnis|résultat"), "decisions").otherwise("facts")
    items = told.where(F.col("line").startswith("- ") & (F.length("line") > 12))
    return items.groupBy("doc_id", "section", route.alias("route")).agg(F.count(F.lit(1)).alias("n_items"))


def root_causes(docs: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """``doc_id, pos, score``: 0.95 for a confirmed hypothesis, 0.05 for a rejected one, else the word overlap with its
    whole document (0.3 at least) and 0.05 for each bullet (0.25 at most), 0.9 at most."""
    facts = docs.select("doc_id", F.size(F.filter(lines(F.col("content")), lambda x: x.startswith("- "))).alias("n"), F.array_distinct(tokens(F.col("content"))).alias("head"))
    like = jaccard(F.array_distinct(tokens(F.col("hypothesis"))), F.col("head"))
    open_score = F.least(F.lit(0.9), F.greatest(F.lit(0.3), like) + F.least(F.lit(0.25), 0.05 * F.col("n")))
    score = F.when(F.col("status") == "confirmed", 0.95).when(F.col("status") == "rejected", 0.05).otherwise(open_score)
    return hypotheses.join(facts, "doc_id").select("doc_id", "pos", score.alias("score"))


def runbooks(events: DataFrame) -> DataFrame:
    """Upserted runbooks per pattern: highest confidence, uses, and the sorted union of severities seen."""
    severity = F.when(F.col("value") >= 75, "critical").when(F.col("value") >= 25, "medium").otherwise("low")
    return events.groupBy(F.col("event_type").alias("pattern")).agg(F.max("value").alias("confidence"), F.count(F.lit(1)).alias("n_uses"), F.array_join(F.array_sort(F.collect_set(severity)), ",").alias("severities"))


def finished_tasks(events: DataFrame, as_of: str, days: int) -> DataFrame:
    """Users whose last event is a purchase at least ``days`` before ``as_of``."""
    last = events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("b"))
    age = F.datediff(F.lit(as_of).cast("date"), F.col("b.ts").cast("date"))
    return last.where((F.col("b.event_type") == "purchase") & (age >= days)).select("user_id", age.alias("age"))


def prompt_summary(events: DataFrame, mark: float = 50.0) -> DataFrame:
    """Per user: runs, passed ones, their share and the decision (at least half pass: keep)."""
    rows = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("value") >= mark, 1)).alias("n_pass"), F.max("value").alias("best"))
    rate = F.col("n_pass") / F.col("n")
    return rows.select("user_id", "n", "n_pass", "best", rate.alias("pass_rate"), F.when(rate >= 0.5, "keep").otherwise("revise").alias("decision"))


def brief(docs: DataFrame, view: DataFrame, edges: DataFrame, entity: str, most: int = 10) -> DataFrame:
    """``part, line`` about an entity: its newest documents, its keys and its most frequent relations."""
    newest = docs.where(F.col("entity") == entity).orderBy(F.desc("mtime"), "doc_id").limit(most).select(F.lit("document").alias("part"), F.col("stem").alias("line"))
    keys = view.where(F.col("entity") == entity).select(F.lit("key").alias("part"), F.col("key").alias("line")).distinct()
    ties = edges.where(F.col("from_id") == entity).groupBy("relation").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "relation").limit(most)
    return newest.unionByName(keys).unionByName(ties.select(F.lit("relation").alias("part"), F.concat_ws(" ", "relation", "n").alias("line")))


def chunk_search(chunks: DataFrame, query: str, top: int = 20) -> DataFrame:
    """``doc_id, score``: best share of query words in a chunk (``doc_id, chunk``)."""
    words = list(dict.fromkeys(tokens_of(query)))
    share = sum((F.lower("chunk").contains(w).cast("int") for w in words), F.lit(0)) / F.lit(float(max(len(words), 1)))
    best = chunks.select("doc_id", share.alias("s")).groupBy("doc_id").agg(F.max("s").alias("score"))
    return best.where("score > 0").orderBy(F.desc("score"), "doc_id").limit(top)


def goal_rerank(hits: DataFrame, goal: str) -> DataFrame:
    """``doc_id, score`` of hits lifted by a goal: the whole goal or its words in the text, 0.15 of the best line's ratio,
    slowly decaying kinds of memory, core notes, trusted facts, and conditions that fit."""
    c, low, words = F.col("content"), F.lower("content"), list(dict.fromkeys(tokens_of(goal)))
    share = F.size(F.array_intersect(F.array_distinct(tokens(c)), F.array(*[F.lit(w) for w in words]))) / F.lit(float(len(words)))
    fit = F.when(low.contains(goal.lower()), 0.3).otherwise(0.2 * share)
    kind = 0.05 * (1.0 - decay_rate(memory_type(c)))
    n = {k: F.regexp_count(c, F.lit(f"[Cc]onfidence: {k}")) for k in ("verified", "experimental", "hypothesis")}
    total = n["verified"] + n["experimental"] + n["hypothesis"]
    trust = F.when(total > 0, 0.05 * (n["verified"] + 0.7 * n["experimental"] + 0.4 * n["hypothesis"]) / total).otherwise(0.0)
    core = F.when(low.contains("tier: core"), 0.03).otherwise(0.0)
    line = 0.15 * F.get(similarity([goal.lower()])(F.col("content"), F.lit("")), F.lit(0))
    lift = fit + line + kind + core + trust + condition_bonus(c, goal)
    return hits.select("doc_id", F.least(F.lit(1.0), F.col("score") + lift).alias("score"))


def modality(path: Column) -> Column:
    """Kind of an attachment by its extension; ``binary`` if unknown."""
    ext, out = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)), None
    for kind, known in MODALITIES.items():
        out = F.when(ext.isin(known), kind) if out is None else out.when(ext.isin(known), kind)
    return out.otherwise("binary")


class QueryCache:
    """Results by query, parameters and table version: least recently used out first, and not older than ``ttl`` s."""

    def __init__(self, size: int = 256, ttl: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.size, self.ttl, self.clock, self.rows = size, ttl, clock, OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: Hashable, version: Hashable, make: Callable[[], object]) -> object:
        k, now = (key, version), self.clock()
        if k in self.rows and now - self.rows[k][0] <= self.ttl:
            self.hits += 1
            self.rows.move_to_end(k)
            return self.rows[k][1]
        self.misses += 1
        self.rows[k] = (now, make())
        self.rows.move_to_end(k)
        while len(self.rows) > self.size:
            self.rows.popitem(last=False)
        return self.rows[k][1]
