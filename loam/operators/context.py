"""Strategies by question type, time windows, rendering of hits, merged searches, conflicts and consolidation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.functions.text import keyword_variants, snippet, tokens_of
from loam.operators import extract, facts, fusion, graph, lexical, nearest, ranking, routing
from loam.operators.stores import opposing
from loam.session import cut

#: Phrases of questions that span several sessions.
SPANNING = [
    "last month", "last week", "last year", "last quarter", "last few days",
    "this month", "this week", "this year", "this quarter",
    "past month", "past week", "past year", "past few days",
    "recently", "lately",
    "how many", "how often", "how frequently",
    "across sessions", "between sessions", "all sessions",
    "compare", "comparison", "over time", "throughout",
    "지난달", "지난 달", "지난주", "지난 주", "작년", "지난해",
    "이번달", "이번 달", "이번주", "이번 주", "올해",
    "최근", "요즘",
    "얼마나 자주", "얼마나 많이", "몇 번", "몇번",
]
#: Days of a phrase of time, tested in this order.
WINDOWS = [
    ("last quarter", 90), ("past quarter", 90), ("this quarter", 90),
    ("last year", 365), ("past year", 365), ("this year", 365),
    ("last month", 30), ("past month", 30), ("this month", 30),
    ("last few days", 7), ("past few days", 7),
    ("last week", 7), ("past week", 7), ("this week", 7),
    ("recently", 30), ("lately", 30),
    ("지난달", 30), ("지난 달", 30), ("이번달", 30), ("이번 달", 30),
    ("지난주", 7), ("지난 주", 7), ("이번주", 7), ("이번 주", 7),
    ("작년", 365), ("지난해", 365), ("올해", 365),
    ("최근", 30), ("요즘", 30),
]
UNITS = {"day": 1, "week": 7, "month": 30, "year": 365, "일": 1, "주": 7, "개월": 30, "년": 365}


def spans_sessions(question: Column) -> Column:
    """Whether a question asks over several sessions: by phrase, or by a count within the last days, weeks ..."""
    low = F.lower(question)
    met = F.lit(False)
    for phrase in SPANNING:
        met = met | low.contains(phrase)
    counted = r"(?:how\s+many|how\s+often|얼마나).*(?:in\s+(?:the\s+)?(?:past|last)\s+\d+\s+(?:day|week|month|year)s?|지난\s*\d+\s*(?:일|주|개월|년))"
    return met | low.rlike(counted)


def time_window(question: str, now: str) -> tuple[str, str] | None:
    """First and last day that a question's phrase of time means, which ends ``now``; None without one."""
    low, end = question.lower(), date.fromisoformat(now[:10])
    m = re.search(r"\b(?:in\s+(?:the\s+)?)?(?:past|last)\s+(\d+)\s+(day|week|month|year)s?\b", low) or re.search(r"지난\s*(\d+)\s*(일|주|개월|년)", low)
    days = max(1, int(m[1]) * UNITS[m[2]]) if m else next((n for phrase, n in WINDOWS if phrase in low), None)
    return None if days is None else ((end - timedelta(days=days)).isoformat(), end.isoformat())


def question_type(question: str) -> str:
    """``loam.operators.routing.classify`` of a driver-side string."""
    import regex

    low = question.lower()
    return next((kind for kind, cues in routing.TYPES.items() if regex.search(routing.pattern_of(cues), low)), "general")


def dispatched(docs: DataFrame, edges: DataFrame, view: DataFrame, question: str, as_of: str, top_k: int = 5) -> DataFrame:
    """``doc_id, score, question_type, strategy``: the strategy of the question's type, and a fuzzy search if that finds
    nothing; a blank question finds nothing."""
    kind = question_type(question)
    if not question.strip():
        return lexical.search(docs.limit(0), "x", as_of).select("doc_id", "score", F.lit("general").alias("question_type"), F.lit("empty_query").alias("strategy"))
    fuzzy = lambda: lexical.composite(docs, question, as_of, fuzzy=True).select("doc_id", "score")
    if kind == "single_session":
        found = lexical.scores(docs, [question], as_of, fuzzy=True).select("doc_id", "score")
    elif kind == "multi_session":
        hits = lexical.scores(docs, [question, *keyword_variants(question)], as_of, fuzzy=True)
        found = hits.groupBy("doc_id").agg(F.max("score").alias("score"))
    elif kind == "knowledge_update":
        found = routing.latest(docs, question, as_of, 30)
    elif kind == "temporal_reasoning":
        found = routing.timeline(docs, question, as_of, 4 * top_k).select("doc_id", (F.lit(1.0) / F.col("pos")).alias("score"))
    elif kind == "preference":
        found = routing.preference(docs, question, as_of, 4 * top_k)
    elif kind == "counting":
        found = routing.counting(docs, edges, question, as_of, max(30, 2 * top_k)).select("doc_id", "score")
    else:
        found = fuzzy()
    best, strategy = cut(lexical.top(found, top_k)), kind
    if kind != "general" and not best.limit(1).count():
        best, strategy = lexical.top(fuzzy(), top_k), f"{kind}, fuzzy"
    return best.select("doc_id", "score", F.lit(kind).alias("question_type"), F.lit(strategy).alias("strategy"))


# --- rendering -------------------------------------------------------------------------------------------------


def annotated(text: Column, valid_from: Column, valid_until: Column, recorded: Column) -> Column:
    """A text behind the time it holds: ``[recorded: r, valid: a ~ b]``, without ``r`` if it is the start, or ``[recorded:
    r]`` alone; as it is if it has a time already or there is none."""
    until = F.coalesce(F.nullif(valid_until, F.lit("")), F.lit("present"))
    span = F.concat(valid_from, F.lit(" ~ "), until)
    tag = (
        F.when(valid_from.isNotNull() & recorded.isNotNull() & (recorded != valid_from), F.concat(F.lit("[recorded: "), recorded, F.lit(", valid: "), span, F.lit("]")))
        .when(valid_from.isNotNull(), F.concat(F.lit("["), span, F.lit("]"))).when(recorded.isNotNull(), F.concat(F.lit("[recorded: "), recorded, F.lit("]")))
    )
    done = F.trim(text).startswith("[") & F.substring_index(F.trim(text), "]", 1).contains(" ~ ")
    return F.when(done | tag.isNull(), text).otherwise(F.trim(F.concat_ws(" ", tag, text)))


def rendered(hits: DataFrame, include_low: bool = True, most: int = 220) -> DataFrame:
    """``pos, line`` of hits (``doc_id, score, stem, snippet, confidence``): high and medium ones by rank, then a head and
    the low ones.  The hits are a list that was cut to its top."""
    text = F.translate(F.trim("snippet"), "\n", " ")
    short = F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)
    low = F.col("confidence") == "low"
    body = F.concat(F.col("stem"), F.when(short != "", F.concat(F.lit(" — "), short)).otherwise(""))
    potential = F.when(low & F.lower("snippet").rlike(ranking.INTENT), " (might indicate acquisition intent)").otherwise("")
    rows = hits.select(low.alias("low"), "score", "doc_id", F.concat(F.lit("["), F.col("confidence"), F.lit(" confidence] "), body, potential).alias("line"))
    rows = rows if include_low else rows.where("not low")
    head = rows.where("low").limit(1).select(F.lit(True).alias("low"), F.lit(float("inf")).alias("score"), F.lit(-1).cast("long").alias("doc_id"), F.lit("--- low confidence (potential / inferred) ---").alias("line"))
    w = Window.orderBy("low", F.desc("score"), "doc_id")
    return rows.unionByName(head).select(F.row_number().over(w).alias("pos"), "line")


def prepared(docs: DataFrame, query: str, as_of: str, kind: str, top_k: int = 20, max_chars: int = 5000) -> DataFrame:
    """``pos, line``: hits of a query re-ranked by question type, packed into ``max_chars`` and rendered."""
    hits = lexical.texts_of(docs, lexical.search(docs, query, as_of, 2 * top_k), "content", "dir", "stem")
    hits = cut(hits.withColumn("snippet", snippet(F.col("content"), tokens_of(query), phrase=query.lower())))
    lifted = ranking.rerank(hits, kind).select("doc_id", "score")
    shown = hits.drop("score").join(F.broadcast(lifted), "doc_id")
    kept = ranking.compress(shown, query, max_chars).select("doc_id")
    chosen = shown.join(F.broadcast(kept), "doc_id").withColumn("confidence", ranking.confidence(F.col("score"), F.col("snippet")))
    return rendered(chosen.select("doc_id", "score", "stem", "snippet", "confidence"))


def disclosed(docs: DataFrame, query: str, level: int) -> DataFrame:
    """Documents that hold a query in text or name, by level: their index row (1), headings (2) or whole text (3)."""
    q = query.lower()
    found = docs.where(F.lower("content").contains(q) | F.lower("stem").contains(q))
    if level == 1:
        body = F.filter(F.split("content", "\n"), lambda x: (F.length(x) > 10) & ~x.rlike("^(?:#|---|tier:|tags:|source:|updated:|confidence:|>|\\||```)"))
        return found.select("doc_id", F.date_format("mtime", "yyyy-MM-dd").alias("day"), extract.tag_of(F.col("content")).alias("tags"), F.substring(F.coalesce(F.get(body, F.lit(0)), F.lit("")), 1, 100).alias("summary"))
    if level == 2:
        return found.select("doc_id", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?m)^(#{1,3} [^\n]*)"), F.lit(1))).alias("pos", "heading"))
    return found.select("doc_id", "content")


# --- merged searches -------------------------------------------------------------------------------------------


def hierarchical(docs: DataFrame, summaries: str, query: str, as_of: str, top_k: int = 5) -> DataFrame:
    """``doc_id, pass, score``: summaries (the documents of one folder) by the share of the query's words of three letters
    that they hold, then, as far as ``top_k`` goes, hits of the plain search; texts with one start of 80 characters once."""
    words = list(dict.fromkeys(w for w in tokens_of(query) if len(w) > 2))
    own = docs.where(F.col("dir") == summaries).select("doc_id", F.lower("content").alias("low"), F.substring("content", 1, 80).alias("key"))
    share = sum((F.col("low").contains(w).cast("int") for w in words), F.lit(0)) / F.lit(float(max(len(words), 1)))
    first = lexical.top(own.select("doc_id", "key", share.alias("score")).where("score > 0"), top_k).withColumn("pass", F.lit(1))
    found = lexical.texts_of(docs, lexical.precise(docs, query, as_of, top_k), "content").select("doc_id", F.substring("content", 1, 80).alias("key"), "score", F.lit(2).alias("pass"))
    once = first.unionByName(found).groupBy("key").agg(F.min(F.struct("pass", (-F.col("score")).alias("back"), "doc_id")).alias("b"))
    return once.select("b.doc_id", "b.pass", (-F.col("b.back")).alias("score")).orderBy("pass", F.desc("score"), "doc_id").limit(top_k)


def graph_paths(edges: DataFrame, docs: DataFrame, query: str, as_of: str, top_k: int = 5) -> DataFrame:
    """``pos, text``: paths of up to two hops from the entities a query names, then hits of the plain search by file name.

    Entities are capitalised words, whole runs of them joined by hyphens, and Korean words without particles.
    """
    runs = [r.lower().replace(" ", "-") for r in re.findall(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b", query)]
    single = [w.lower() for w in re.findall(r"\b[A-Z][a-z]+\b", query) if w.lower() not in extract.STOPS]
    named = list(dict.fromkeys([*runs, *single, *re.findall("[가-힯]{2,}", query)]))
    steps = [graph.walk(edges, n, 2).select(F.lit(i).alias("i"), "depth", F.concat_ws(" ", "from_id", F.concat(F.lit("--"), F.col("relation"), F.lit("-->")), "to_id").alias("text")) for i, n in enumerate(named)]
    rows = lexical.texts_of(docs, lexical.precise(docs, query, as_of, top_k), "stem").select(F.lit(len(named)).alias("i"), F.lit(9).alias("depth"), F.col("stem").alias("text"))
    for s in steps:
        rows = rows.unionByName(s)
    first = rows.groupBy("text").agg(F.min(F.struct("i", "depth")).alias("b")).orderBy("b.i", "b.depth", "text").limit(top_k)
    return first.select(F.row_number().over(Window.orderBy("b.i", "b.depth", "text")).alias("pos"), "text")


def evidence_first(docs: DataFrame, incidents: DataFrame, query: str, as_of: str, limit: int = 10) -> DataFrame:
    """``pos, source, key, score, at``: hits of notes, decisions and incidents that hold the query, merged: scored ones
    first, then the newest.  ``incidents`` has ``id, text, at``."""
    q = query.lower()
    notes = lexical.search(docs, query, as_of, limit).select(F.lit("memory").alias("source"), F.col("doc_id").cast("string").alias("key"), "score", F.lit(None).cast("timestamp").alias("at"))
    made = docs.where((F.col("dir") == "decisions") & F.lower("content").contains(q)).select(F.lit("decision").alias("source"), F.col("doc_id").cast("string").alias("key"), F.lit(None).cast("double").alias("score"), F.col("mtime").cast("timestamp").alias("at"))
    seen = incidents.where(F.lower("text").contains(q)).select(F.lit("incident").alias("source"), F.col("id").cast("string").alias("key"), F.lit(None).cast("double").alias("score"), F.col("at").cast("timestamp").alias("at"))
    newest = lambda x: x.orderBy(F.desc("at"), "key").limit(limit)
    order = [F.desc_nulls_last("score"), F.desc_nulls_last("at"), F.asc("source"), F.asc("key")]
    rows = notes.unionByName(newest(made)).unionByName(newest(seen)).orderBy(*order).limit(limit)
    return rows.select(F.row_number().over(Window.orderBy(*order)).alias("pos"), "source", "key", "score", F.date_format("at", "yyyy-MM-dd").alias("day"))


def preference_reasons(edges: DataFrame, entity: str, query: str, hops: int = 2) -> DataFrame:
    """``target, relation, depth, reasons``: what an entity reaches whose name holds a word of the query (each if it has
    none), at its least depth, and what it is because of."""
    words = [t for t in re.findall(r"[a-z0-9]+", query.lower()) if len(t) > 2]
    met = F.lit(not words)
    for w in words:
        met = met | F.col("to_id").contains(w)
    reached = graph.walk(edges, entity, hops).where(met).groupBy(F.col("to_id").alias("target"), "relation").agg(F.min("depth").alias("depth"))
    why = edges.where("relation = 'because_of'").select(F.col("from_id").alias("target"), F.col("to_id").alias("reason")).distinct()
    told = reached.join(why, "target", "left")
    return told.groupBy("target", "relation", "depth").agg(F.count("reason").alias("n_reasons"), F.min("reason").alias("first_reason"))


# --- conflicts and consolidation -------------------------------------------------------------------------------


@F.arrow_udf(T.DoubleType())
def _ratio(old: pa.Array, new: pa.Array) -> pa.Array:
    from difflib import SequenceMatcher

    return pa.array([SequenceMatcher(None, a, b).ratio() for a, b in zip(old.to_pylist(), new.to_pylist(), strict=True)], pa.float64())


def conflicting(bullets: DataFrame, new: str, threshold: float = 0.4) -> DataFrame:
    """``doc_id, line_no, fact, similarity`` of bullets (``doc_id, line_no, fact``) that contradict a new fact: as similar as
    ``threshold``, not equal, and opposed in wording, in the value of one field, or (between 0.6 and 0.95) in all but the
    first two words."""
    low = new.lower().strip()
    rows = bullets.withColumn("_l", F.lower(F.trim("fact"))).where(F.col("_l") != low)
    rows = lexical.once(rows, similarity=_ratio(F.col("_l"), F.lit(low))).where(F.col("similarity") >= threshold)
    old_words, new_words = F.split(F.col("_l"), r"\s+"), low.split()
    subject = F.lit(False)
    if len(new_words) > 2:
        subject = (F.size(old_words) > 2) & (F.slice(old_words, 1, 2) == F.array(*[F.lit(w) for w in new_words[:2]])) & (F.concat_ws(" ", old_words) != " ".join(new_words))
    met = opposing(F.col("_l"), F.lit(low)) | ((F.col("similarity") > 0.6) & (F.col("similarity") < 0.95) & subject)
    return rows.where(met).select("doc_id", "line_no", "fact", (F.floor(F.col("similarity") * 100 + F.lit(0.5)) / F.lit(100.0)).alias("similarity"))


def settled(view: DataFrame) -> DataFrame:
    """``entity, key, value, vf, closed_to``: facts that lose a contradiction and when they end: at the start of the newest
    recorded fact of their key, if that has another value and overlaps them.

    The newest fact of a key is one row, so no pairs are made; ties of recording go to the later start, then the line.
    """
    kept = view.where("value is not null")
    best = kept.groupBy("entity", "key").agg(F.max(F.struct("recorded", F.coalesce("vf", F.lit("")).alias("f"), (-F.col("line_no")).alias("back"), "value", "vf", "vt")).alias("b"))
    rows = kept.join(best, ["entity", "key"]).where("value != b.value")
    a, b = F.coalesce("vf", F.lit(facts.LOW)), F.coalesce("vt", F.lit(facts.HIGH))
    overlaps = (a <= F.coalesce("b.vt", F.lit(facts.HIGH))) & (F.coalesce("b.vf", F.lit(facts.LOW)) <= b)
    return rows.where(overlaps).select("entity", "key", "value", "vf", "line_no", F.col("b.vf").alias("closed_to"), F.col("b.value").alias("winner"))


def consolidated(view: DataFrame, nodes: DataFrame, edges: DataFrame, documents: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    """``stage, n``: what each stage of a consolidation would change: repeated facts, stale ones, nodes that nothing names,
    entities to observe, and facts that lose a contradiction."""
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
    repeated = facts.deduplicated(view).agg(F.coalesce(F.sum(F.col("n_copies") - 1), F.lit(0)).alias("n")).select(F.lit("duplicates").alias("stage"), "n")
    parts = [one("stale", facts.stale(view, as_of, days)), one("orphans", graph.orphan_nodes(nodes, edges, documents)), one("observations", facts.observations(view, as_of)), one("contradictions", settled(view))]
    for p in parts:
        repeated = repeated.unionByName(p)
    return repeated


def health(docs: DataFrame, view: DataFrame, nodes: DataFrame, as_of: str) -> DataFrame:
    """``assertion, n_bad, passed, grade``: sources of entity notes, facts of unknown entities, repeated facts, inbox items
    older than a week, and facts in conflict; the grade is that of the share passed (A 80, B 60, C 40)."""
    page = F.col("dir").isin("entities", "live-notes")
    age = F.datediff(F.lit(as_of).cast("date"), F.col("mtime").cast("date"))
    sums = docs.agg(F.count(F.when(page & ~F.col("content").contains("[Source:"), 1)).alias("source_attribution"), F.count(F.when((F.col("dir") == "inbox") & (age > 7), 1)).alias("no_stale_inbox"))
    bad = sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("assertion"), F.col(c).alias("n_bad")) for c in ("source_attribution", "no_stale_inbox")])))
    known = nodes.where("id is not null").select(F.col("id").alias("entity")).distinct()
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(name).alias("assertion"), "n_bad")
    bad = bad.unionByName(count("no_orphan_facts", view.join(known, "entity", "left_anti"))).unionByName(count("no_duplicate_facts", facts.deduplicated(view).where("n_copies > 1"))).unionByName(count("no_conflicts", facts.conflicting_keys(view)))
    rate = F.avg((F.col("n_bad") == 0).cast("double")).over(Window.partitionBy())
    grade = F.when(rate >= 0.8, "A").when(rate >= 0.6, "B").when(rate >= 0.4, "C").otherwise("D")
    return bad.select("assertion", "n_bad", (F.col("n_bad") == 0).alias("passed"), grade.alias("grade"))


# --- similar labels, all queries ---------------------------------------------------------------------------------


def _packed(size: int):
    """A partition's rows as lists of ``size`` rows or a batch more, numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        first, no = TaskContext.get().partitionId() << 32, 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            lists = [pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), c.chunk(0)) for c in t.columns]
            return pa.RecordBatch.from_arrays([pa.array([first + no], pa.int64()), *lists], ["block", *(f"{n}s" for n in t.column_names)])

        for b in batches:
            held += [b] if b.num_rows else []
            if sum(x.num_rows for x in held) >= size:
                yield block()
                held, no = [], no + 1
        if held:
            yield block()

    return run


def similar_all(nodes: DataFrame, every: int = 20, top: int = 10, block: int = 16_384, chunk: int = 65_536) -> DataFrame:
    """``query_no, id, score``: the ``top`` ids whose labels are most like that of each node row with a number divisible by
    ``every``, its own id apart; cosine of character-bigram tf-idf as in ``graph.similar``.

    A task lets blocks of labels pass by its queries and multiplies only pairs that can still reach a query's best ``top``
    (``nearest``); so at most ``top`` rows per query and sixteen chunks are shuffled.  Of equal labels the smallest ids
    can be among the best, one more than ``top`` as the own id does not count.
    """
    labels = cut(nodes.where("id is not null and label is not null").groupBy("id").agg(F.lower(F.min("label")).alias("label")))
    n = labels.count()
    context = nodes.sparkSession.sparkContext
    counts = labels.select("label").mapInArrow(nearest.labels_by_bigram, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    model = context.broadcast(nearest.weights(counts["code"].to_numpy(), counts["n"].to_numpy(), n))
    asked = cut(nodes.where((F.col("node_no") % every == 0) & F.col("id").isNotNull()).select(F.col("node_no").alias("no"), "id").join(labels, "id").select("no", "id", "label"))
    n_asked = asked.count()
    parts = max(-(-n_asked // block), min(context.defaultParallelism, -(-n_asked // 64)), 1)
    least = labels.withColumn("_p", F.row_number().over(Window.partitionBy("label").orderBy("id"))).where(F.col("_p") <= top + 1).select("id", "label")
    queries = cut(asked.repartition(parts).mapInArrow(_packed(block), "block long, nos array<long>, ids array<string>, labels array<string>"))
    blocks = cut(least.repartition(max(1, -(-n // (16 * chunk)))).mapInArrow(_packed(chunk), "block long, ids array<string>, labels array<string>"))
    met = blocks.select(F.col("ids").alias("x"), F.col("labels").alias("xs")).hint("shuffle_replicate_nl").crossJoin(queries)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[pa.Array, nearest.Nearest]] = {}
        for b in batches:
            for i in range(b.num_rows):
                x, xs, nos, ids, texts = (b.column(c)[i].values for c in (0, 1, 3, 4, 5))
                no = b.column(2)[i].as_py()
                if no not in found:
                    found[no] = nos, nearest.Nearest(ids, texts, model.value, top)
                found[no][1].see(x, xs)
        for nos, best in found.values():
            yield pa.RecordBatch.from_arrays([nos.take(pa.array(best.q)), best.id, pa.array(best.score)], ["query_no", "id", "score"])

    best = met.mapInArrow(scored, "query_no long, id string, score double")
    w = Window.partitionBy("query_no").orderBy(F.desc("score"), "id")
    return best.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= top).drop("_p")


def fused(docs: DataFrame, query: str, as_of: str, top_k: int = 20) -> DataFrame:
    """``doc_id, rrf_score, n_lists``: a query and its variants fused by reciprocal rank; all are scored in one scan."""
    lists = lexical.search_lists(docs, [query, *keyword_variants(query)], as_of, 3 * top_k)
    return fusion.rrf(lists).orderBy(F.desc("rrf_score"), "doc_id").limit(top_k)
