"""Retrieval in several passes: text, graph neighbours and facts; hybrid with vectors; snapshots; recall of experience."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import tokens, tokens_of
from loam.operators import facts, fusion, lexical
from loam.operators.reports import cosine, vector_literal
from loam.session import cut


def three_pass(docs: DataFrame, edges: DataFrame, view: DataFrame, query: str, as_of: str, top_k: int = 20) -> DataFrame:
    """``entity, score, n_lists`` of entities by reciprocal-rank fusion of three passes.

    Pass 1: entities of the best documents.  Pass 2: neighbours of the best five of them, by the share of query words
    in the neighbour's name.  Pass 3: facts of the same five, newest best.  Seeds are five rows, so their joins
    broadcast a fixed size.
    """
    hits = cut(lexical.top(lexical.composite(docs, query, as_of, keep=["entity"]), 2 * top_k))
    named = hits.where("entity is not null")
    first = named.groupBy("entity").agg(F.max("score").alias("score"))
    seeds = first.orderBy(F.desc("score"), "entity").limit(5).select(F.col("entity").alias("seed"))
    near = edges.join(F.broadcast(seeds), F.col("from_id") == F.col("seed")).select(F.col("to_id").alias("entity"))
    q = F.array(*[F.lit(t) for t in dict.fromkeys(tokens_of(query))])
    shared = F.size(F.array_intersect(tokens(F.translate("entity", "-", " ")), q)) / F.size(q)
    second = near.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).select("entity", (F.lit(0.4) + 0.6 * shared + F.least(F.lit(0.1), F.col("n") / 100.0)).alias("score"))
    second = second.orderBy(F.desc("score"), "entity").limit(3 * top_k)
    since = view.join(F.broadcast(seeds), F.col("entity") == F.col("seed")).where("vf is not null").groupBy("value").agg(F.max("vf").alias("vf"))
    age = F.datediff(F.lit(as_of).cast("date"), F.substring("vf", 1, 10).try_cast("date"))
    third = since.where("value is not null").select(F.lower("value").alias("entity"), (F.lit(1.0) / (1.0 + F.greatest(age, F.lit(0)) / 365.0)).alias("score"))
    third = third.groupBy("entity").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "entity").limit(3 * top_k)
    return fusion.rrf([first, second, third], "entity").orderBy(F.desc("rrf_score"), "entity").limit(top_k)


def hybrid(a: DataFrame, b: DataFrame, alpha: float = 0.5, k: int = fusion.RRF_K) -> DataFrame:
    """Weighted reciprocal-rank fusion of two lists and its confidence ``min(1, fused * (k + 1))``."""
    both = fusion.rrf([a, b], k=k, weights=[1 - alpha, alpha])
    return both.withColumn("confidence", F.least(F.lit(1.0), F.col("rrf_score") * (k + 1)))


def nearest(embeddings: DataFrame, query: list[float], top: int) -> DataFrame:
    q = vector_literal(query)
    return embeddings.where("vec_id is not null").select(F.col("vec_id").alias("doc_id"), cosine(F.col("embedding"), q).alias("score")).orderBy(F.desc("score"), "doc_id").limit(top)


def time_travel(snapshots: DataFrame, day: str, query: str) -> DataFrame:
    """``path, score`` in the latest snapshot (``taken``, ``path``, ``content``) of ``day`` or before: 1.0 for the whole
    query, else half the share of its words."""
    latest = snapshots.where(F.col("taken") <= day).agg(F.max("taken")).first()[0]
    words = list(dict.fromkeys(tokens_of(query)))
    low = F.lower("content")
    share = sum((low.contains(w).cast("int") for w in words), F.lit(0)) / F.lit(float(max(len(words), 1)))
    score = F.when(low.contains(query.lower()), 1.0).otherwise(0.5 * share)
    return snapshots.where(F.col("taken") == latest).select("path", score.alias("score")).where("score > 0")


def recall(docs: DataFrame, query: str, top_k: int = 20, min_score: float = 0.01) -> DataFrame:
    """``doc_id, score``: Jaccard overlap of a record's whole text and the query; newest first among equals."""
    q = F.array(*[F.lit(t) for t in dict.fromkeys(tokens_of(query))])
    words = F.array_distinct(tokens(F.col("content")))
    union = F.size(F.array_union(words, q))
    rows = docs.select("doc_id", "mtime", (F.size(F.array_intersect(words, q)) / union).alias("score")).where(F.col("score") >= min_score)
    return rows.orderBy(F.desc("score"), F.desc("mtime"), "doc_id").limit(top_k).select("doc_id", "score")


def evidence(docs: DataFrame, query: str, as_of: str, days: int = 900, min_similarity: float = 0.3) -> DataFrame:
    """``doc_id, score``: containment of the query in a document, less with age (a tenth at least)."""
    q = F.array(*[F.lit(t) for t in dict.fromkeys(tokens_of(query))])
    share = F.size(F.array_intersect(F.array_distinct(tokens(F.col("content"))), q)) / F.size(q)
    age = F.datediff(F.lit(as_of).cast("date"), F.col("mtime").cast("date"))
    fresh = F.greatest(F.lit(0.1), 1 - F.greatest(age, F.lit(0)) / float(days))
    return docs.where(share >= min_similarity).select("doc_id", (share * fresh).alias("score"))


def session_blocks(turns: DataFrame, block: int = 30) -> DataFrame:
    """``doc_id, session, n_turns``: a session begins at a user turn that greets after any assistant turn; sessions are
    cut into blocks.  A conversation is one document, which bounds the group."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    greets = (F.col("role") == "USER") & F.lower("text").rlike("^(?:hi|hello|hey|good morning|can you remind)")
    begins = F.when(greets & (F.max(F.when(F.col("role") == "ASSISTANT", 1).otherwise(0)).over(w) == 1), 1).otherwise(0)
    numbered = turns.withColumn("begins", begins).withColumn("no", F.sum("begins").over(w)).withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "no").orderBy("pos")))
    session = F.concat_ws(".", F.col("no"), F.floor((F.col("rn") - 1) / block))
    return numbered.groupBy("doc_id", session.alias("session")).agg(F.count(F.lit(1)).alias("n_turns"))


def turns(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, role, text`` of conversation turns."""
    p = r"\[(USER|ASSISTANT|SYSTEM)\] *([^\n\r]*)"
    parts = [F.regexp_extract_all("content", F.lit(p), F.lit(i)).alias(n) for i, n in ((1, "r"), (2, "t"))]
    return docs.select("doc_id", F.posexplode(F.arrays_zip(*parts)).alias("pos", "z")).select("doc_id", "pos", F.col("z.r").alias("role"), F.col("z.t").alias("text"))


def related(rows: DataFrame, top: int = 3) -> DataFrame:
    """``incident, other, score`` for incidents whose id is divisible by 20, against all of the same affected user:
    1 if the severities agree, 0.5 else, less 0.01 for each day apart; the best ``top``."""
    asked = rows.where("event_id % 20 = 0").select("user_id", F.col("event_id").alias("incident"), F.col("severity").alias("s"), F.col("ts").alias("t"))
    met = asked.join(rows, "user_id").where("incident != event_id")
    score = F.when(F.col("s") == F.col("severity"), 1.0).otherwise(0.5) - 0.01 * F.abs(F.datediff("t", "ts"))
    scored = met.select("incident", F.col("event_id").alias("other"), score.alias("score"))
    w = Window.partitionBy("incident").orderBy(F.desc("score"), "other")
    return scored.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= top)


def persona_context(view: DataFrame, entity: str, day: str) -> DataFrame:
    """``layout, line`` for one entity: the current value of each key, its evolution, and its keys by number of values."""
    own = view.where((F.col("entity") == entity) & F.col("value").isNotNull())
    now = facts.fact_at(own, day).select(F.lit("current").alias("layout"), F.concat_ws(": ", "key", "value").alias("line"))
    steps = own.where("vf is not null").groupBy("key", "vf").agg(F.max("value").alias("value"))
    path = steps.select(F.lit("evolution").alias("layout"), F.concat_ws(" ", "key", "vf", "value").alias("line"))
    count = own.groupBy("key").agg(F.countDistinct("value").alias("n")).select(F.lit("by_key").alias("layout"), F.concat_ws("=", "key", "n").alias("line"))
    return now.unionByName(path).unionByName(count)


def compound(docs: DataFrame, query: str, as_of: str, top_k: int = 20) -> DataFrame:
    """``doc_id, score``: a compound question by its parts, then one hop along the wiki links of the hits.

    The parts are scored in one scan, merged by their maximum and cut to ``top_k``; documents about what those link to score 0.3
    for each word of the question they hold and 0.5 for a whole part, 1.0 at most.
    """
    from loam.functions.text import links, subqueries

    parts = subqueries(query)
    first = cut(lexical.top(fusion.maximum(lexical.search_lists(docs, parts, as_of, top_k)), top_k))
    targets = lexical.texts_of(docs, first, "content").select(F.explode(links(F.col("content"))).alias("entity")).distinct()
    low = F.lower("content")
    words = sum((low.contains(w).cast("int") for w in dict.fromkeys(tokens_of(query))), F.lit(0))
    whole = F.lit(False)
    for p in parts:
        whole = whole | low.contains(p.lower())
    score = F.least(F.lit(1.0), 0.3 * words + F.when(whole, 0.5).otherwise(0.0))
    hop = docs.join(targets, "entity", "left_semi").join(F.broadcast(first.select("doc_id")), "doc_id", "left_anti").select("doc_id", score.alias("score")).where("score > 0")
    return first.unionByName(hop).orderBy(F.desc("score"), "doc_id").limit(2 * top_k)
