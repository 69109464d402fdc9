"""Records in and around notes: pages, tables, routes, decisions, runbooks, attachments, summaries, answers and preferences."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.functions.text import chunk_size, chunks, jaccard, lines, run_lengths, strip, tokens, tokens_of
from loam.operators.extract import section_of, tag_of
from loam.operators.facts import HIGH, clean_value, negative_preference
from loam.operators.reports import STOPS
from loam.operators.routing import user_turns
from loam.operators.stores import modality

#: Cues of routes, tested in this order; anything else is an entity.
ROUTES = {"decision": ["decided", "decision", "chose", "agreed"], "task": ["todo", "task", "action item", "need to", "must"]}
#: Wordings that decline an answer.
ABSTENTIONS = ["i don't know", "i do not know", "not enough", "cannot determine", "cannot find"]


def entity_pages(docs: DataFrame) -> DataFrame:
    """``doc_id, stem, n_bullets, n_timeline, tags`` of entity pages and live notes."""
    rows = docs.where(F.col("dir").isin("entities", "live-notes"))
    n = lambda p: F.size(F.filter(lines(F.col("content")), lambda x: x.rlike(p)))
    return rows.select("doc_id", "stem", n("^- ").alias("n_bullets"), n(r"^- \*\*\d{4}-\d{2}-\d{2}\*\*").alias("n_timeline"), tag_of(F.col("content")).alias("tags"))


def changed_since(docs: DataFrame, since: str) -> DataFrame:
    """``doc_id, dir`` of documents changed after a time; the newest first is the reader's order."""
    return docs.where(F.col("mtime") > F.lit(since).cast("timestamp")).select("doc_id", "dir")


def table_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, row, entity, info``: rows of Markdown tables behind the first line, their first cell (two characters at
    least) and the others joined by bars."""
    rows = F.filter(lines(F.col("content")), lambda x: F.trim(x).startswith("|") & ~x.contains("---"))
    told = docs.select("doc_id", F.posexplode(rows).alias("row", "line")).where("row > 0")
    cells = F.filter(F.transform(F.split("line", r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return told.select("doc_id", "row", F.get(cells, F.lit(0)).alias("entity"), F.array_join(F.slice(cells, 2, 1_000_000), " | ").alias("info")).where(F.length("entity") > 1)


def list_items(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, item``: list items of more than ten characters, without a leading date in brackets."""
    rows = docs.select("doc_id", F.posexplode(lines(F.col("content"))).alias("line_no", "line"))
    item = F.trim(F.regexp_extract(strip(F.col("line")), r"^[-*]\s+(?:\[[\d\-]+\]\s*)?(.+)$", 1))
    return rows.select("doc_id", "line_no", item.alias("item")).where(F.length("item") > 10)


def route_of(text: Column) -> Column:
    """Where a note of an inbox belongs: the first route one of whose cues it has."""
    out = None
    for name, cues in ROUTES.items():
        met = F.lit(False)
        for c in cues:
            met = met | F.lower(text).contains(c)
        out = F.when(met, name) if out is None else out.when(met, name)
    return out.otherwise("entity")


def routed_inbox(docs: DataFrame, least: int = 20) -> DataFrame:
    """``doc_id, route`` of inbox notes of ``least`` characters or more."""
    return docs.where((F.col("dir") == "inbox") & (F.length(strip(F.col("content"))) >= least)).select("doc_id", route_of(F.col("content")).alias("route"))


def compression_hints(docs: DataFrame, bloated: int = 4000) -> DataFrame:
    """``doc_id, hint`` of bloated documents: what to condense, merge or split."""
    rows = F.transform(lines(F.col("content")), lambda x: F.trim(x))
    timeline = F.size(F.filter(rows, lambda x: x.startswith("- **") & F.substring(x, 5, 1_000_000).contains("**")))
    points = F.size(F.filter(rows, lambda x: x.startswith("- ") & x.contains("[Source:")))
    hints = F.concat_ws(
        "; ",
        F.when(timeline > 20, F.concat(F.lit("condense timeline ("), timeline, F.lit(")"))),
        F.when(points > 10, F.concat(F.lit("merge points ("), points, F.lit(")"))),
        F.when(F.length("content") > 8000, F.lit("split or archive")),
    )
    return docs.where(F.length("content") > bloated).select("doc_id", F.coalesce(F.nullif(hints, F.lit("")), F.lit("condense")).alias("hint"))


def page_summaries(docs: DataFrame, sections: list[str], most: int = 500) -> DataFrame:
    """``doc_id, summary``: the first five bullets of each section and the first three lines of the timeline, joined by line
    ends and cut to ``most``; documents without any are left out."""
    first = lambda name, mark, n: F.slice(F.filter(F.transform(F.split(section_of(F.col("content"), name), "\n"), lambda x: F.trim(x)), lambda x: x.startswith(mark)), 1, n)
    parts = F.concat(*[first(s, "- ", 5) for s in sections], first("Timeline", "- **", 3))
    return docs.select("doc_id", F.substring(F.array_join(parts, "\n"), 1, most).alias("summary")).where("summary != ''")


def decision_search(docs: DataFrame, query: str, start: str, end: str, tag: str = "", limit: int = 50) -> DataFrame:
    """``doc_id, day``: decisions of a period that hold the query and the tag, the newest first."""
    c = F.col("content")
    rows = docs.where((F.col("dir") == "decisions") & F.lower(c).contains(query.lower()) & tag_of(c).contains(tag)).withColumn("day", F.date_format("mtime", "yyyy-MM-dd"))
    return rows.where(F.col("day").between(start, end)).orderBy(F.desc("mtime"), "doc_id").limit(limit).select("doc_id", "day")


def matching_sentences(sentences: DataFrame, words: list[str]) -> DataFrame:
    """Sentences with the number of ``words`` they hold; those without any are left out (with no words none is)."""
    n = sum((F.lower("sentence").contains(w).cast("int") for w in words), F.lit(0))
    return sentences.withColumn("n_hits", n).where(F.lit(not words) | (F.col("n_hits") > 0))


def runbook_matches(runbooks: DataFrame, symptom: str, least: float = 0.2, limit: int = 5) -> DataFrame:
    """``id, score`` of runbooks (``id, pattern, confidence``) for a symptom: 0.6 of the similarity (1 if the pattern, as a
    regular expression, fits) and 0.4 of the confidence."""
    low = symptom.strip().lower()

    @F.arrow_udf(T.DoubleType())
    def similar(patterns: pa.Array) -> pa.Array:
        import re
        from difflib import SequenceMatcher

        def one(p: str | None) -> float:
            ratio = SequenceMatcher(None, low, (p or "").lower()).ratio()
            if p and any(ch in p for ch in ".*+?[]|()"):
                try:
                    ratio = 1.0 if re.search(p, symptom, re.IGNORECASE) else ratio
                except re.error:
                    pass
            return ratio

        return pa.array([one(p) for p in patterns.to_pylist()], pa.float64())

    score = F.floor((0.6 * similar("pattern") + 0.4 * F.coalesce("confidence", F.lit(0.0))) * 10_000 + F.lit(0.5)) / F.lit(10_000.0)
    rows = runbooks.select("id", F.col("confidence").alias("c"), F.explode(F.array(score)).alias("score"))
    return rows.where(F.lit(bool(low)) & (F.col("score") >= least)).orderBy(F.desc("score"), F.desc("c"), "id").limit(limit).select("id", "score")


def attachments(docs: DataFrame) -> DataFrame:
    """``doc_id, file, modality``: files that a note links to (``![[file.ext]]``, ``[[file.ext]]`` or ``(file.ext)``)."""
    found = F.regexp_extract_all("content", F.lit(r"[\w\-/]+\.[A-Za-z0-9]{1,8}(?=\]\]|\))"), F.lit(0))
    rows = docs.select("doc_id", F.explode(F.array_distinct(found)).alias("file"))
    return rows.select("doc_id", "file", modality(F.col("file")).alias("modality"))


def by_modality(docs: DataFrame) -> DataFrame:
    """``modality, n, n_chars`` of documents by the ending of their path."""
    return docs.groupBy(modality(F.col("path")).alias("modality")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("n_chars"))


def hits_with_attachments(hits: DataFrame, files: DataFrame, kind: str) -> DataFrame:
    """Hits whose document has an attachment of a modality, with their number; the hits are a list cut to its top."""
    n = files.where(F.col("modality") == kind).join(F.broadcast(hits.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_files"))
    return hits.join(n, "doc_id")


def document_summaries(docs: DataFrame, most: int = 10) -> DataFrame:
    """``doc_id, keywords``: most frequent words of what users say (of the whole text without turns); counted within the row,
    equals in alphabetical order."""
    c = F.col("content")
    said = F.array_join(F.regexp_extract_all(c, F.lit(r"(?s)\[USER\](.*?)(?=\[(?:USER|ASSISTANT|SYSTEM)\]|$)"), F.lit(1)), " ")
    words = F.filter(F.regexp_extract_all(F.lower(F.when(said != "", said).otherwise(c)), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: ~w.isin(STOPS))
    best = F.slice(F.array_sort(F.transform(F.map_entries(run_lengths(words)), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("w")))), 1, most)
    return docs.select("doc_id", F.array_join(F.transform(best, lambda x: x["w"]), ",").alias("keywords"))


def normalised(text: Column) -> Column:
    """Lower case, marks and runs of white space to one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]", " "), r"[\s\p{Z}]+", " "))


def scored_answers(answers: DataFrame) -> DataFrame:
    """``category, n, exact, contains, abstained`` shares of answers (``category, predicted, gold``), by category and overall
    in one pass."""
    p, g = normalised(F.col("predicted")), normalised(F.col("gold"))
    declined = F.lit(False)
    for a in ABSTENTIONS:
        declined = declined | F.lower(F.coalesce("predicted", F.lit(""))).contains(a)
    flags = answers.select(F.coalesce("category", F.lit("(none)")).alias("category"), (p == g).cast("int").alias("e"), ((g != "") & p.contains(g)).cast("int").alias("c"), declined.cast("int").alias("a"))
    rows = flags.rollup("category").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("exact"), F.avg("c").alias("contains"), F.avg("a").alias("abstained"))
    return rows.select(F.coalesce("category", F.lit("(all)")).alias("category"), "n", "exact", "contains", "abstained")


def set_preference(view: DataFrame, entity: str, key: str, value: str, day: str) -> DataFrame:
    """``key, value, vf, vt`` of an entity after a preference was set: open ones of the key that began by then end on
    ``day``, and the new one is open."""
    own = view.where(F.col("entity") == entity)
    ends = (F.col("key") == key) & F.col("vt").isNull() & (F.col("vf").isNull() | (F.col("vf") <= day))
    kept = own.select("key", "value", "vf", F.when(ends, F.lit(day)).otherwise(F.col("vt")).alias("vt"))
    new = own.sparkSession.createDataFrame([(key, value, day, None)], "key string, value string, vf string, vt string")
    return kept.unionByName(new)


def preferences_at(view: DataFrame, day: str) -> DataFrame:
    """``entity, n_positive, n_negative, n_dropped``: preferences that hold on ``day`` by polarity, and those that are no
    short phrases."""
    rows = view.where(F.col("value").isNotNull() & (F.coalesce("vt", F.lit(HIGH)) >= day) & (F.col("vf").isNull() | (F.col("vf") <= day)))
    clean, bad = clean_value(F.col("value")), negative_preference(F.col("key"), F.col("value"))
    n = lambda c: F.count(F.when(c, 1))
    return rows.groupBy("entity").agg(n(clean & ~bad).alias("n_positive"), n(clean & bad).alias("n_negative"), n(~clean).alias("n_dropped"))


def session_fusion(smart: DataFrame, precise: DataFrame, weight: float = 0.6) -> DataFrame:
    """``doc_id, score``: two lists scaled by their best scores and weighed ``weight`` and the rest; lists are cut to their
    top."""
    scaled = lambda x, w: x.select("doc_id", (w * F.try_divide(F.col("score"), F.max("score").over(Window.partitionBy()))).alias("s"))
    return scaled(smart, weight).unionByName(scaled(precise, 1 - weight)).groupBy("doc_id").agg(F.sum(F.coalesce("s", F.lit(0.0))).alias("score"))


def relevant_sessions(docs: DataFrame, question: str, most: int = 20) -> DataFrame:
    """``doc_id, score``: conversations by the word overlap of the question with what the users say."""
    asked = F.array(*[F.lit(t) for t in dict.fromkeys(tokens_of(question))]).cast("array<string>")
    turns = user_turns(docs).select("doc_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("w")).distinct()
    words = turns.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.array_contains(asked, F.col("w")), 1)).alias("met"))
    score = F.col("met") / (F.col("n") + F.size(asked) - F.col("met"))
    return words.where("met > 0").select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(most)


def checked_answer(docs: DataFrame, answer: str, least: float = 0.5) -> DataFrame:
    """``doc_id, coverage``: documents that hold at least ``least`` of an answer's words."""
    words = list(dict.fromkeys(tokens_of(answer)))
    asked = F.array(*[F.lit(t) for t in words]).cast("array<string>")
    share = F.size(F.array_intersect(F.array_distinct(tokens(F.col("content"))), asked)) / F.lit(float(max(len(words), 1)))
    return docs.select("doc_id", F.explode(F.array(share)).alias("coverage")).where(F.col("coverage") >= least)


def chunk_pages(docs: DataFrame, overlap: int = 50) -> DataFrame:
    """``name, parent, text``: chunks as pages of their own, named after their document and number."""
    rows = docs.select("stem", F.posexplode(chunks(F.col("content"), chunk_size(F.length("content")), overlap)).alias("no", "text"))
    return rows.select(F.concat(F.col("stem"), F.lit("__c"), F.col("no")).alias("name"), F.col("stem").alias("parent"), "text")


def hit_key(file: Column, entity: Column, key: Column, value: Column, relation: Column, target: Column, seed: Column) -> Column:
    """What a hit is about, so that hits of several kinds can be merged: its file, fact, edge or entity."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    fact = F.concat_ws("\x1f", F.lit("fact"), low(entity), F.coalesce(key, F.lit("")), F.coalesce(value, F.lit("")))
    edge = F.concat_ws("\x1f", F.lit("graph"), low(target), relation, F.coalesce(seed, F.lit("")))
    return F.when(file.isNotNull() & (file != ""), F.concat_ws("\x1f", F.lit("file"), file)).when(entity.isNotNull() | key.isNotNull(), fact).when(relation.isNotNull(), edge).otherwise(F.concat_ws("\x1f", F.lit("entity"), low(target)))


def similar_titles(docs: DataFrame, query: str, least: float = 0.1) -> DataFrame:
    """``doc_id, score``: word overlap of a query with the title (the file name) of each document."""
    q = F.array(*[F.lit(t) for t in dict.fromkeys(tokens_of(query))]).cast("array<string>")
    score = jaccard(F.array_distinct(tokens(F.translate("stem", "-", " "))), q)
    return docs.select("doc_id", F.explode(F.array(score)).alias("score")).where(F.col("score") >= least)
