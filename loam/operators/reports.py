"""Reports over documents and events: keywords, categories, statements, incidents, evaluation, vectors."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.functions.text import WORD, chunk_size, chunks, jaccard, lines, run_lengths, tokens, words_of
from loam.plans.components import components
from loam.plans.ordered import TARGET_ROWS, bucketed
from loam.session import cut

COMMON_SHARE = 10_000

#: Words that are no keywords.
STOPS = """the a an is are was were be been being have has had do does did will would could should may might can shall must need i me my mine
we our us you your yours he she it they them his her its their this that these those what which who whom how when where why if then than so and
but or not no yes very too also just only more most some any all each every both few many much other another for with about from into through
during before after above below between under over to of in on at by as up out off really actually think know like feel want get got make made
go going come say said tell told ask asked thing things something anything everything nothing user assistant system sure well yeah okay right
now here there always never still even back way lot one two""".split()

#: Cue words of categories and sentiments.
CATEGORIES = {
    "food": "food cuisine restaurant cooking recipe dish meal eat ate eating chef bake baking diet flavor kitchen".split() + ["farmers market", "ingredient", "vegetarian", "vegan"],
    "music": "music song playlist concert artist genre band album melody rhythm beat remix dj instrument guitar piano vocal lyric podcast audio".split(),
    "travel": "travel trip vacation hotel flight destination adventure explore tour journey backpack resort".split(),
    "entertainment": "movie film show series book novel reading game gaming hobby sport theater exhibit video youtube stream streaming".split(),
    "work": "work career job professional business project client colleague office startup company employer".split(),
    "health": "health fitness exercise wellness medical yoga running gym workout meditation therapy sleep".split(),
    "education": "education learning course study school university research class degree tutor".split(),
    "technology": "tech software coding programming app digital computer ai".split() + ["machine learning", "data", "api", "website"],
    "creative": "art design photography writing painting drawing creative sketch sculpture craft".split(),
    "relationships": "friend family partner spouse kids children parents dating marriage".split(),
    "finance": "money invest stock budget saving finance".split(),
}
NEGATIVE = ["stopped", "quit", "gave up", "hate", "hated", "dislike", "disliked", "avoid", "avoided", "can't stand", "discourag", "stifl", "no longer", "not a fan", "didn't like", "don't like", "chaotic", "unproductive", "disappoint", "frustrat", "boring", "tired of", "fed up"]
POSITIVE = ["love", "loved", "enjoy", "enjoyed", "excited", "thrilled", "passion", "inspired", "fulfill", "rewarding", "amazing", "wonderful", "great", "fantastic", "started", "began", "curated", "created", "organized", "launched", "explored", "learn", "discovered", "embrac"]
#: Marks of what is open, and words of decisions (the Latin ones in lower case).
PENDING = ["pending", "waiting", "대기", "필요", "블로커", "확인 필요", "TODO", "FIXME", "[ ]", "⏳", "미해결", "미완료"]
DECIDED = ["decided", "decision", "chose", "agreed", "approved", "rejected", "postponed", "결정", "채택", "승인", "보류", "통일", "제한", "확정"]


def hits(text: Column, cues: list[str]) -> Column:
    """How many of the cues the lower-cased text contains."""
    return sum((F.lower(text).contains(c).cast("int") for c in cues), F.lit(0))


def category(text: Column) -> Column:
    """The category with most cues, the first of equals; ``general`` without any."""
    scores = [(name, hits(text, cues)) for name, cues in CATEGORIES.items()]
    best = F.greatest(*[s for _, s in scores])
    out = F.when(best == 0, "general")
    for name, s in scores:
        out = out.when(s == best, name)
    return out


def sentiment(text: Column) -> Column:
    neg, pos = hits(text, NEGATIVE), hits(text, POSITIVE)
    return F.when(neg > pos, "negative").when(pos > neg, "positive").otherwise("neutral")


def sentences(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, sentence_no, sentence``: sentences of each line, bullets and marks kept."""
    rows = docs.select("doc_id", F.posexplode(lines(F.col("content"))).alias("line_no", "line"))
    parts = F.filter(F.transform(F.split(F.regexp_replace("line", r"([.!?])[ \t\r\f]+", "$1\n"), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("doc_id", "line_no", F.posexplode(parts).alias("sentence_no", "sentence"))


def statements(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, sentence_no, kind, category, sentiment`` of sentences, by the first kind that fits."""
    s = F.lower("sentence")
    kind = (
        F.when(s.rlike("(?:^|[^a-z])(?:started|began|now works)"), "start").when(s.rlike("switched|moved|replaced"), "switch").when(s.rlike("stopped|dropped|no longer"), "stop")
        .when(s.rlike("(?:^|[^a-z])(?:i like|loves?|enjoys?)(?:$|[^a-z])"), "like").when(s.rlike("hate|dislike|could not"), "dislike").when(s.rlike("prefer|favou?rite|better than"), "favorite")
        .when(s.rlike("(?:^|[^a-z])(?:is|are|was|lives|works|pays|owns)(?:$|[^a-z])"), "fact").when(sentiment(F.col("sentence")) != "neutral", "sentiment").otherwise("general")
    )
    return sentences(docs).select("doc_id", "line_no", "sentence_no", kind.alias("kind"), category(F.col("sentence")).alias("category"), sentiment(F.col("sentence")).alias("sentiment"))


def keywords(docs: DataFrame, most: int = 10) -> DataFrame:
    """``doc_id, word, n, pos``: most frequent English words of a document; equals in alphabetical order.

    A row holds all words of its document, so they are counted and ranked within it, without a shuffle.
    """
    words = F.filter(F.regexp_extract_all(F.lower("content"), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: ~w.isin(STOPS))
    best = F.slice(F.array_sort(F.transform(F.map_entries(run_lengths(words)), lambda e: F.struct((-e["value"]).alias("less"), e["key"].alias("word")))), 1, most)
    rows = docs.select("doc_id", F.posexplode(best).alias("pos", "b"))
    return rows.select("doc_id", "b.word", (-F.col("b.less")).cast("long").alias("n"), (F.col("pos") + 1).alias("pos"))


def chunked(docs: DataFrame, overlap: int = 50) -> DataFrame:
    """``doc_id, chunk_no, n_chars, hash`` of overlapping windows of a size that follows the document's."""
    rows = docs.select("doc_id", F.posexplode(chunks(F.col("content"), chunk_size(F.length("content")), overlap)).alias("chunk_no", "chunk"))
    return rows.select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"), F.md5(F.encode("chunk", "UTF-8")).alias("hash"))


#: Numeric facts worth a registry; dates apart, the case of letters doesn't count.
VALUES = {
    "currency": r"(?i)[\$₩€]\s?[\d,.]+(?:\s*(?:million|billion|trillion|만|억|조|M|B|K))?\b",
    "percent": r"(?i)\d+(?:\.\d+)?%",
    "counted": r"(?i)\d+(?:,\d+)*(?:\s+(?:items|users|employees|members|people|명|개|건|팀))",
    "date": r"\d{4}-\d{2}-\d{2}",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "status": r"status: [a-z]+",
}


def _values(kind: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(0)), lambda v: F.concat(F.lit(kind + "\x1f"), F.trim(v)))


def extracted(docs: DataFrame) -> DataFrame:
    """``doc_id, kind, value, n``: amounts, shares, counted things, dates, addresses and handles that a document names; one
    scan, counted within the row."""
    found = F.flatten(F.array(*[_values(k, p) for k, p in VALUES.items()]))
    rows = docs.select("doc_id", F.explode(F.map_entries(run_lengths(found))).alias("e"))
    parts = F.split("e.key", "\x1f")
    return rows.select("doc_id", parts[0].alias("kind"), parts[1].alias("value"), F.col("e.value").cast("long").alias("n"))


def open_loops(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, day``: lines, headings apart, with a mark of what is open (in its very letters)."""
    rows = docs.select("doc_id", F.date_format("mtime", "yyyy-MM-dd").alias("day"), F.posexplode(lines(F.col("content"))).alias("line_no", "line"))
    met = F.lit(False)
    for c in PENDING:
        met = met | F.col("line").contains(c)
    return rows.where(~F.trim("line").startswith("#") & met).select("doc_id", "line_no", "day")


def decisions(docs: DataFrame, events: DataFrame) -> DataFrame:
    """``source, key, line_no, importance``: candidates of decisions, of three kinds.

    Events whose type or properties have a word of decisions; documents of the folder ``decisions`` that have one
    (high); and lines, headings apart, of notes in no folder.
    """
    of = lambda c: hits(c, DECIDED) > 0
    said = events.where(of(F.concat_ws(" ", "event_type", "props"))).select(F.lit("event").alias("source"), F.col("event_id").alias("key"), F.lit(0).alias("line_no"), F.lit("normal").alias("importance"))
    kept = docs.where((F.col("dir") == "decisions") & of(F.col("content"))).select(F.lit("decision").alias("source"), F.col("doc_id").alias("key"), F.lit(0).alias("line_no"), F.lit("high").alias("importance"))
    rows = docs.where("dir = 'base'").select(F.col("doc_id").alias("key"), F.posexplode(lines(F.col("content"))).alias("line_no", "line"))
    noted = rows.where(~F.col("line").startswith("#") & of(F.col("line"))).select(F.lit("note").alias("source"), "key", "line_no", F.lit("normal").alias("importance"))
    return said.unionByName(kept).unionByName(noted)


def debug_hypotheses(docs: DataFrame) -> DataFrame:
    """``doc_id, no, status, hypothesis`` of ``### Hn:`` headings and the status line that follows."""
    p = r"### H(\d+): ([^\n\r]*)\r?\n(?:status: ([a-z]+))?"
    parts = [F.regexp_extract_all("content", F.lit(p), F.lit(i)) for i in (1, 2, 3)]
    rows = docs.select("doc_id", F.posexplode(F.arrays_zip(*[x.alias(n) for x, n in zip(parts, ("no", "h", "s"), strict=True)])).alias("pos", "z"))
    return rows.select("doc_id", "pos", F.col("z.no").cast("int").alias("no"), F.col("z.s").alias("status"), F.col("z.h").alias("hypothesis"))


def debug_status(docs: DataFrame) -> DataFrame:
    """Per document: hypotheses by status and the last one still in test (0: none)."""
    rows = debug_hypotheses(docs)
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s}")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), n("confirmed"), n("rejected"), n("testing"), F.coalesce(F.max(F.when(F.col("status") == "testing", F.col("no"))), F.lit(0)).alias("current"))


def debug_search(docs: DataFrame, query: str) -> DataFrame:
    """``doc_id, source``: debug sessions that hold the query in any case."""
    return docs.where((F.col("dir") == "debug") & F.lower("content").contains(query.lower())).select("doc_id", F.col("dir").alias("source"))


def rejected(docs: DataFrame, query: str) -> DataFrame:
    """``doc_id, no, hypothesis``: rejected hypotheses that hold the query in any case."""
    return debug_hypotheses(docs).where((F.col("status") == "rejected") & F.lower("hypothesis").contains(query.lower())).select("doc_id", "no", "hypothesis")


def near_lines(docs: DataFrame) -> DataFrame:
    """``line, n_docs, n_lines``: bullet lines that agree once numbers, names and marks are dropped, in several
    documents.  One row per form; no pairs are made.  Lines that are merely similar are linked by ``similar_lines``."""
    rows = docs.select("doc_id", F.explode(lines(F.col("content"))).alias("line")).where(F.col("line").startswith("- ") & (F.length("line") > 12))
    shape = F.array_join(F.filter(F.regexp_extract_all("line", F.lit(WORD), F.lit(0)), lambda w: ~w.rlike(r"^(?:\p{Lu}|[0-9])")), " ")
    return rows.select("doc_id", shape.alias("line")).where("line != ''").groupBy("line").agg(F.countDistinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_lines")).where("n_docs > 1")


def bullets(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, line``: bullets of more than ten characters, without source tags and outer white space."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    rows = docs.select("doc_id", F.posexplode(lines(F.col("content"))).alias("line_no", "line")).withColumn("line", strip(F.col("line")))
    rows = rows.where(F.col("line").startswith("- ") & (F.length("line") > 10))
    return rows.withColumn("line", strip(F.regexp_replace("line", r"\[Source:.*?\]", ""))).where(F.col("line").startswith("- "))


def _numbered(line: str) -> list[tuple[str, int]]:
    """Words of a line; the k-th of equal words is a token of its own."""
    seen: Counter[str] = Counter()
    out = []
    for w in line.split():
        seen[w] += 1
        out.append((w, seen[w]))
    return out


def word_ratio(a: str, b: str) -> float:
    """The ratio of difflib over the words of two lines, the smaller line first."""
    a, b = sorted((a, b))
    return SequenceMatcher(None, a.split(), b.split()).ratio()


def _often(distinct: DataFrame) -> dict[str, int]:
    """Lines of each word in a ten-thousandth of the lines or more, which bounds what is broadcast."""
    counts = distinct.select(F.explode(F.array_distinct(words_of(F.col("line")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return {r["word"]: r["n"] for r in counts.where(F.col("n") >= max(2, distinct.count() // COMMON_SHARE)).collect()}


def _code(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1


def _line_groups(distinct: DataFrame, often: Broadcast, threshold: float) -> DataFrame:
    """``no, line, rep``: lines that agree but for their rarest word have the smallest of them as ``rep``, if they reach
    the threshold with it; others have themselves.  A form with thousands of dates or names is so tied without pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rests = []
            for line in b.column(1).to_pylist():
                words = line.split()
                at = min(range(len(words)), key=lambda i: (often.value.get(words[i], 0), words[i]))
                rests.append(_code(" ".join([*words[:at], "", *words[at + 1 :]])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rests, pa.int64())], ["no", "line", "rest"])

    rows = distinct.select("no", "line").mapInArrow(run, "no long, line string, rest long")
    least = rows.groupBy("rest").agg(F.min(F.struct("line", "no")).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select("rest", "m")
    tied = rows.join(least.hint("merge"), "rest", "left")
    return tied.select("no", "line", F.when(F.col("m").isNotNull() & _alike(threshold)(F.coalesce("m.line", "line"), "line"), F.col("m.no")).otherwise(F.col("no")).alias("rep"))


def _line_keys(rows: DataFrame, often: Broadcast, threshold: float) -> DataFrame:
    """``key, no, rep, side, gap, bits``: hashed pairs of the rarest words of each line, for each number of words of a partner;
    ``side`` is 1 for a longer partner, -1 for a shorter one.  Words that lines do not share flip one bit of ``bits`` each
    at most, so more than ``gap`` flipped bits rule a pair out.

    Lines of ``a`` and ``b`` words that reach the threshold share ``need = threshold / 2 * (a + b)`` of them or more,
    so the two rarest shared words are among the ``a - need + 2`` rarest of the one and ``b - need + 2`` of the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = often.value
        for batch in batches:
            keys, nos, reps, sides, gaps, bits = [], [], [], [], [], []
            for no, line, rep in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = sorted(_numbered(line), key=lambda w: (count.get(w[0], 0), w))
                a, reach = len(words), threshold / (2 - threshold)
                codes: list[int] = []
                for b in range(math.ceil(reach * a - 1e-9), math.floor(a / reach + 1e-9) + 1):
                    most = a - math.ceil(threshold / 2 * (a + b) - 1e-9) + 2
                    codes += [_code(f"{w} {k}") for w, k in words[len(codes) : most]]
                    sizes = min(a, b) * 1_000_003 + max(a, b)
                    keys += [((x * 0x9E3779B97F4A7C15 + y) * 31 + sizes) % (1 << 63) for x, y in combinations(codes[:most], 2)]
                    sides += [(b > a) - (b < a)] * (len(keys) - len(sides))
                    gaps += [math.floor((1 - threshold) * (a + b) + 1e-9)] * (len(keys) - len(gaps))
                flips = 0
                for w, k in words:
                    flips ^= 1 << _code(f"{w} {k}") % 63
                bits += [flips] * (len(keys) - len(bits))
                nos += [no] * (len(keys) - len(nos))
                reps += [rep] * (len(keys) - len(reps))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (keys, nos, reps, sides, gaps, bits)], ["key", "no", "rep", "side", "gap", "bits"])

    return rows.select("no", "line", "rep").mapInArrow(run, "key long, no long, rep long, side long, gap long, bits long")


def _alike(threshold: float):
    @F.arrow_udf(T.BooleanType())
    def alike(xs: pa.Array, ys: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(xs.to_pylist(), ys.to_pylist(), strict=True):
            a, b = x.split(), y.split()
            most = 2 * (Counter(a) & Counter(b)).total() / max(1, len(a) + len(b))
            out.append(x == y or (most >= threshold and word_ratio(x, y) >= threshold))
        return pa.array(out, pa.bool_())

    return alike


def similar_lines(docs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``doc_id, line_no, class_line``: every bullet with the smallest line of its class.

    Two lines are linked if difflib's ratio of their words is ``threshold`` or more; classes are connected lines.
    Candidates are complete (``_line_keys``) and verified; lines that ``_line_groups`` ties are not paired again.
    Every join is a merge: the size of lines is estimated from the compressed documents, far too low to broadcast by.
    """
    rows = bullets(docs)
    distinct = cut(rows.select("line").distinct().withColumn("no", F.monotonically_increasing_id()))
    often = distinct.sparkSession.sparkContext.broadcast(_often(distinct))
    tied = cut(_line_groups(distinct, often, threshold))
    keys = _line_keys(tied, often, threshold)
    met = keys.where("side >= 0").alias("a").join(keys.where("side <= 0").alias("b").hint("merge"), F.col("a.key") == F.col("b.key")).where("a.rep != b.rep and (a.side > 0 or a.no < b.no) and bit_count(a.bits ^ b.bits) <= a.gap")
    pairs = met.select(F.least("a.no", "b.no").alias("u"), F.greatest("a.no", "b.no").alias("v")).distinct()
    text = lambda no, line: distinct.select(F.col("no").alias(no), F.col("line").alias(line)).hint("merge")
    pairs = pairs.join(text("u", "x"), "u").join(text("v", "y"), "v")
    links = pairs.where(_alike(threshold)("x", "y")).select("u", "v").unionByName(tied.where("no != rep").select(F.col("no").alias("u"), F.col("rep").alias("v")))
    found = components(cut(links))
    grouped = cut(distinct.join(found.withColumnRenamed("node", "no").hint("merge"), "no", "left").select("line", F.coalesce("component", "no").alias("class")))
    least = grouped.groupBy("class").agg(F.min("line").alias("class_line"))
    return rows.join(grouped.join(least.hint("merge"), "class").select("line", "class_line").hint("merge"), "line").select("doc_id", "line_no", "class_line")


# --- events ---------------------------------------------------------------------------------------------------


def incidents(events: DataFrame) -> DataFrame:
    """Errors as incidents: ``event_id, user_id, ts, severity`` by fixed thresholds of the value."""
    severity = F.when(F.col("value") >= 75, "critical").when(F.col("value") >= 50, "high").when(F.col("value") >= 25, "medium").otherwise("low")
    return events.where("event_type = 'error'").select("event_id", "user_id", "ts", severity.alias("severity"))


def incident_search(events: DataFrame, severities: list[str], start: str, end: str, limit: int = 100) -> DataFrame:
    rows = incidents(events).where(F.col("severity").isin(severities) & (F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
    return rows.orderBy(F.desc("ts"), "event_id").limit(limit).select("event_id", "user_id", "severity")


def patterns(events: DataFrame, min_count: int = 2, top: int = 30) -> DataFrame:
    """Most frequent (type, user) patterns with first and last time seen."""
    rows = events.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
    return rows.where(F.col("n") >= min_count).orderBy(F.desc("n"), "event_type", "user_id").limit(top)


def latest_state(events: DataFrame) -> DataFrame:
    """Last event of each user (a combinable maximum)."""
    return events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("b"), F.count(F.lit(1)).alias("n_events")).select("user_id", F.col("b.event_id").alias("event_id"), F.col("b.event_type").alias("event_type"), "n_events")


def convergence(events: DataFrame, window: int = 5) -> DataFrame:
    """Per event type: range and mean of the last ``window`` values, and whether they settled (range at most a tenth of
    the mean).  The row-number limit is applied per task before the shuffle."""
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    last = events.withColumn("r", F.row_number().over(w)).where(F.col("r") <= window)
    rows = last.groupBy("event_type").agg((F.max("value") - F.min("value")).alias("spread"), F.avg("value").alias("mean"))
    return rows.select("event_type", "spread", "mean", (F.col("spread") <= 0.1 * F.abs("mean")).alias("settled"))


def evaluation(events: DataFrame) -> DataFrame:
    """Score by category and overall in one pass (grouping sets): share of values of at least the median mark 50."""
    rows = events.rollup("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("value") >= 50, 1).otherwise(0)).alias("n_pass"))
    return rows.select(F.coalesce("event_type", F.lit("(all)")).alias("category"), "n", "n_pass", (F.col("n_pass") / F.col("n")).alias("pass_rate"))


def majority(events: DataFrame) -> DataFrame:
    """Most frequent event type of each user; ties go to the first in alphabetical order."""
    counts = events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "event_type")).alias("b")).select("user_id", F.col("b.event_type").alias("winner"), (-F.col("b.k")).alias("n"))


def stratified(events: DataFrame, n: int = 100) -> DataFrame:
    """A sample of about ``n`` rows with each type's share, at least one each, chosen by a hash of the id."""
    sizes = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 1
    quota = sizes.select("event_type", F.greatest(F.lit(1), F.floor(F.lit(float(n)) * F.col("size") / total + F.lit(0.5))).alias("quota"))
    w = Window.partitionBy("event_type").orderBy(F.md5(F.col("event_id").cast("string").cast("binary")))
    first = events.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)
    return first.join(quota, "event_type").where("pos <= quota").select("event_id", "event_type", "pos")


def daily(events: DataFrame) -> DataFrame:
    """Tumbling day windows: events, users and sum of values per type."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return events.groupBy(day, "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"), F.max("value").alias("top_value"))


def sessions(events: DataFrame, gap_minutes: int = 30, target_rows: int = TARGET_ROWS) -> DataFrame:
    """``user_id, start_us, n, first_id``: sessions per user, events less than ``gap_minutes`` apart.

    A session begins where the event before is further away; the running number of beginnings names it.  Users with many
    events are cut into ranges of time.  Events without a time belong to no session.
    """
    rows = events.where("user_id is not null and ts is not null")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    times = cut(rows.select("user_id", us.alias("us"), "event_id").groupBy("user_id", "us").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id")))
    line = bucketed(times, ["user_id"], "us", target_rows).neighbours({"before": "us"}, {})
    new = F.when(F.col("before").isNull() | (F.col("us") - F.col("before") >= gap_minutes * 60_000_000), 1).otherwise(0)
    told = line.column("new", new).running_total("new", "no", "_all").df
    return told.groupBy("user_id", "no").agg(F.min("us").alias("start_us"), F.sum("n").alias("n"), F.min("first_id").alias("first_id")).drop("no")


def retro(events: DataFrame) -> DataFrame:
    """Per day what went well (purchases, signups), badly (errors), and how many users were there."""
    n = lambda c: F.count(F.when(c, 1))
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(n(F.col("event_type").isin("purchase", "signup")).alias("well"), n(F.col("event_type") == "error").alias("bad"), F.countDistinct("user_id").alias("n_users"))


# --- vectors --------------------------------------------------------------------------------------------------


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, other lengths or a zero norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0) | norm.isNull(), 0.0).otherwise(dot(a, b) / norm)


def vector_literal(query: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query]) if query else F.array().cast("array<double>")


def first_vector(embeddings: DataFrame) -> list[float]:
    """Vector of the smallest id; empty if there is none."""
    row = embeddings.where("embedding is not null").orderBy("vec_id").first()
    return list(row["embedding"]) if row else []


def vector_topk(embeddings: DataFrame, query: list[float], top: int = 10) -> DataFrame:
    """``vec_id, label, score`` of the nearest vectors, compared with every one."""
    q = vector_literal(query)
    return embeddings.where("vec_id is not null").select("vec_id", "label", cosine(F.col("embedding"), q).alias("score")).orderBy(F.desc("score"), "vec_id").limit(top)


def vector_topk_all(embeddings: DataFrame, every: int = 20, top: int = 10, block: int = 64) -> DataFrame:
    """``query_id, vec_id, score``: the nearest vectors of each whose id is divisible by ``every``, itself among them.

    Queries come in blocks of ``block``, each compared with every vector of its size in one product per batch.  A task keeps
    the best ``top`` of a query, so at most ``top`` rows per query and task are shuffled; equals go to the smallest id.
    Null and repeated queries give no further rows; other sizes and zero norms score 0.
    """
    rows = embeddings.where("vec_id is not null").select("vec_id", "embedding")
    asked = rows.where((F.col("vec_id") % every == 0) & F.col("embedding").isNotNull()).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = asked.groupBy(F.floor(F.col("vec_id") / (every * block)).alias("block")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("queries"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best: dict[int, list[tuple[float, int]]] = {}
            for ids, vectors, queries in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for size in {len(q["embedding"]) for q in queries}:
                    some = [q for q in queries if len(q["embedding"]) == size]
                    matrix = np.array([v if v is not None and len(v) == size else [0.0] * size for v in vectors], np.float64).reshape(len(vectors), size)
                    asks = np.array([q["embedding"] for q in some], np.float64).reshape(len(some), size)
                    norms = np.outer(np.sqrt((asks * asks).sum(1)), np.sqrt((matrix * matrix).sum(1)))
                    dots = asks @ matrix.T
                    scores = np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
                    for q, s in zip(some, scores.tolist(), strict=True):
                        best[q["vec_id"]] = heapq.nsmallest(top, best.get(q["vec_id"], []) + [(-x, v) for x, v in zip(s, ids, strict=True)])
            out = [(q, v, -x) for q, found in best.items() for x, v in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    chunk = F.pmod(F.xxhash64("vec_id"), F.greatest(F.lit(1), F.floor(F.lit(rows.count()) / 1024))).alias("chunk")
    chunks_of = rows.groupBy(chunk).agg(F.collect_list(F.struct("vec_id", F.col("embedding"))).alias("vs"))
    met = chunks_of.select(F.col("vs.vec_id").alias("ids"), F.col("vs.embedding").alias("vectors")).crossJoin(blocks.select("queries"))
    found = met.mapInArrow(scored, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= top).select("query_id", "vec_id", "score")


def vector_stats(embeddings: DataFrame) -> DataFrame:
    return embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("least_dim"), F.max(F.size("embedding")).alias("most_dim"))


def changed_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to embed again: those whose fingerprint is not known."""
    return new.join(old, ["doc_id", "fingerprint"], "left_anti").select("doc_id")


def term_overlap(docs: DataFrame, query: str) -> DataFrame:
    """``doc_id, score``: Jaccard overlap of a document's words with a query's."""
    from loam.functions.text import tokens_of

    q = F.array(*[F.lit(t) for t in dict.fromkeys(tokens_of(query))])
    return docs.select("doc_id", jaccard(F.array_distinct(tokens(F.col("content"))), q).alias("score")).where("score > 0")
