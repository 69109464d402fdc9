"""Lexical retrieval: BM25, the composite scorer and its query-expanding, gated and time-aware forms.

The words of a query are counted in each document, so one scan gives the signals of all queries asked together, a few
numbers a document; document frequencies and scores come from these, and term tables are never shuffled.  Texts never travel:
what is ranked are ids and scores, and the texts of the few best documents are read again by their ids.  For a corpus
that is asked often, ``write_postings`` keeps term frequencies by hash of the term, and a query reads its terms only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.functions.text import cents, keyword_variants, run_lengths, tokens, tokens_of
from loam.session import cut

K1, B = 1.5, 0.75
POSTING_BUCKETS = 256
#: Tables of ``write_postings``; an empty corpus leaves no file that would tell them.
POSTINGS = {"postings": "doc_id long, dl int, term string, tf int, bucket int", "terms": "term string, df long, bucket int"}


def corpus(documents: DataFrame) -> DataFrame:
    """Canonical view: ``doc_id, path, dir, stem, content, mtime, entity``; null text is empty, null source ``base``."""
    return documents.select(
        "doc_id",
        "path",
        F.coalesce("source", F.lit("base")).alias("dir"),
        F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "").alias("stem"),
        F.coalesce("text", F.lit("")).alias("content"),
        "mtime",
        "entity",
    )


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: documents and their mean number of tokens."""
    return docs.select(F.size(tokens(F.col("content"))).alias("n")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("avg_tokens"))


def term_stats(docs: DataFrame) -> DataFrame:
    """Per term: documents that hold it and its occurrences; counted in the row, then one combined shuffle by term."""
    per_doc = docs.select(F.explode(run_lengths(tokens(F.col("content")))).alias("term", "tf"))
    return per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row: the optimizer copies no expression out of a generator, as it does when
    it moves a filter below a projection."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def lowered(docs: DataFrame) -> DataFrame:
    """Add ``_low`` and ``_name``: text and file name in lower case."""
    return once(docs, _low=F.lower(F.coalesce("content", F.lit(""))), _name=F.lower(F.translate("stem", "-", " ")))


def quoted(text: str) -> str:
    """A string literal of Spark SQL.  Expressions of many terms are built as text: one call to the JVM for each, not one for
    each operator."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _word(term: str) -> str:
    return quoted(rf"(?<![\p{{L}}\p{{N}}_])\Q{term}\E(?![\p{{L}}\p{{N}}_])")


def counts_of(terms: Sequence[str]) -> dict[str, Column]:
    """``dl`` (tokens of the document) and ``tf0``, ``tf1`` ... (occurrences of each term) of rows with ``_low``.

    Tokens are the runs of two or more word characters, so they are counted by a pattern and never materialised; a
    term's occurrences are only counted in documents that contain its letters.
    """
    of = lambda t: F.expr(f"CASE WHEN contains(_low, {quoted(t)}) THEN regexp_count(_low, {_word(t)}) ELSE 0 END")
    return {"dl": F.regexp_count("_low", F.lit(r"[\p{L}\p{N}_]{2,}")), **{f"tf{i}": of(t) for i, t in enumerate(terms)}}


def frequencies(rows: DataFrame, terms: Sequence[str]) -> dict:
    """``n, avgdl, df`` of the corpus: one row, whatever the corpus."""
    r = rows.selectExpr("count(1) AS n", "sum(dl) AS dl", *[f"count_if(tf{i} > 0) AS df{i}" for i in range(len(terms))]).first()
    n = r["n"]
    return {"n": n, "avgdl": (r["dl"] or 0) / max(n, 1) or 1.0, "df": [r[f"df{i}"] or 0 for i in range(len(terms))]}


def in_name(term: str) -> Column:
    """Whether the file name has the term as a word."""
    return F.expr(f"contains(_name, {quoted(term)}) AND _name RLIKE {_word(term)}")


def bm25(stats: dict, terms: Sequence[str], names: bool = True, only: Sequence[str] | None = None) -> str:
    """SQL of Okapi BM25 (k1 = 1.5, b = 0.75); with ``names`` a term that is only in the file name (``nm0``, ``nm1`` ...) counts
    once.  ``terms`` are those that were counted; with ``only`` some of them are scored."""
    parts = ["0D"]
    for i, t in enumerate(terms):
        if only is None or t in only:
            idf = math.log((stats["n"] - stats["df"][i] + 0.5) / (stats["df"][i] + 0.5) + 1.0)
            tf = f"CAST(CASE WHEN tf{i} = 0 AND nm{i} THEN 1 ELSE tf{i} END AS DOUBLE)" if names else f"CAST(tf{i} AS DOUBLE)"
            parts.append(f"CASE WHEN {tf} > 0 THEN {idf!r}D * {tf} * {K1 + 1!r}D / ({tf} + {K1!r}D * ({1 - B!r}D + {B!r}D * dl / {float(stats['avgdl'])!r}D)) ELSE 0D END")
    return "(" + " + ".join(parts) + ")"


def bm25_topk(docs: DataFrame, query: str, top_k: int = 20) -> DataFrame:
    """``doc_id, score`` of the best documents by plain BM25; ties by ``doc_id``.  No terms, no rows.

    Texts are read once: what they count is cut, and both frequencies and scores come from there.
    """
    terms = list(dict.fromkeys(tokens_of(query)))
    rows = cut(once(lowered(docs), **counts_of(terms)).select("doc_id", "dl", *[f"tf{i}" for i in range(len(terms))]))
    scored = once(rows, score=F.expr(bm25(frequencies(rows, terms), terms, names=False))).select("doc_id", "score")
    return scored.where("score > 0").orderBy(F.desc("score"), "doc_id").limit(top_k)


def bucket_of(term: Column, buckets: int = POSTING_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_postings(docs: DataFrame, folder: str, buckets: int = POSTING_BUCKETS) -> None:
    """Write ``postings`` (``term, doc_id, tf, dl``, partitioned by hash of the term), ``terms`` (``term, df``, the same)
    and ``totals`` (``n, dl``) below ``folder``.

    A row is counted in itself, so the one shuffle is that of the rows to the folders of their terms; a term that every
    document holds is spread over several files (``part``), so no task gets all of a hot term.
    """
    rows = docs.select("doc_id", F.regexp_count(F.lower("content"), F.lit(r"[\p{L}\p{N}_]{2,}")).alias("dl"), F.explode(run_lengths(tokens(F.col("content")))).alias("term", "tf"))
    placed = rows.withColumn("bucket", bucket_of(F.col("term"), buckets)).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    ordered = placed.repartition("bucket", "part").sortWithinPartitions("bucket", "term", "doc_id").drop("part")
    ordered.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    kept = docs.sparkSession.read.schema(POSTINGS["postings"]).parquet(f"{folder}/postings")
    df = kept.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"))
    df.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/terms")
    totals = docs.select(F.regexp_count(F.lower("content"), F.lit(r"[\p{L}\p{N}_]{2,}")).alias("dl"))
    totals.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl")).write.mode("overwrite").parquet(f"{folder}/totals")


def bm25_postings(spark: SparkSession, folder: str, query: str, top_k: int = 20, buckets: int = POSTING_BUCKETS) -> DataFrame:
    """``bm25_topk`` from written postings: only the folders of the query's terms are read, and no text."""
    terms = list(dict.fromkeys(tokens_of(query)))
    if not terms:
        return spark.createDataFrame([], "doc_id long, score double")
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    at = [r["b"] for r in asked.select(bucket_of(F.col("term"), buckets).alias("b")).distinct().collect()]
    own = lambda name: spark.read.schema(POSTINGS[name]).parquet(f"{folder}/{name}").where(F.col("bucket").isin(at) & F.col("term").isin(terms))
    total = spark.read.parquet(f"{folder}/totals").first()
    df = {r["term"]: r["df"] for r in own("terms").collect()}
    n, avgdl = total["n"], (total["dl"] or 0) / max(total["n"], 1) or 1.0
    idf = F.lit(0.0)
    for t in terms:
        idf = F.when(F.col("term") == t, math.log((n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5) + 1.0)).otherwise(idf)
    tf = F.col("tf").cast("double")
    score = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / avgdl))
    return own("postings").groupBy("doc_id").agg(F.sum(score).alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(top_k)


def expand_aliases(query: str, aliases: DataFrame) -> list[str]:
    """Query tokens, then canonicals and further aliases of each token and of the whole phrase, in order."""
    words = tokens_of(query)
    keys = list(dict.fromkeys([*words, query.strip().lower()]))
    known = aliases.where(F.lower("alias").isin(keys) & F.col("canonical").isNotNull()).select(F.lower("alias").alias("a"), F.lower("canonical").alias("c"))
    extra = [r["c"] for r in known.distinct().orderBy("a", "c").collect()]
    return list(dict.fromkeys(words + [t for c in extra for t in tokens_of(c)]))


def scores(docs: DataFrame, queries: Sequence[str], as_of: str, fuzzy: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Composite score of every document that matches a query: ``q`` (the query's place), ``doc_id, stem, score`` and the
    columns of ``keep``.

    Signals: the whole query in the body (1.0) or the file name (0.8); overlap weighted by unlogged idf; BM25
    scaled to 1; query bigrams, a heading that holds the query, recent dates, and with ``fuzzy`` the best
    similarity of a line or the name.  Of documents with one stem the best counts (ties: smallest ``doc_id``).
    Texts are read once for all queries: their signals, a few numbers a document, are cut, and frequencies and scores come
    from there; ids and scores are combined before the shuffle.
    """
    asked = [q.strip().lower() for q in queries]
    own = [list(dict.fromkeys(tokens_of(q))) for q in queries]
    terms = list(dict.fromkeys(t for x in own for t in x))
    met = " OR ".join(f"contains({c}, {quoted(t)})" for t in dict.fromkeys([*terms, *asked]) for c in ("_low", "_name"))
    dates = F.regexp_extract_all("content", F.lit(r"\*\*(\d{4}-\d{2}-\d{2})\*\*"), F.lit(1))
    age = F.datediff(F.lit(as_of).cast("date"), F.array_max(F.when(F.expr(met), dates)).try_cast("date"))
    signals = counts_of(terms) | {f"nm{i}": in_name(t) for i, t in enumerate(terms)} | {"recency": F.when(age < 7, 0.05).when(age < 30, 0.02).otherwise(0.0)}
    for k, q in enumerate(asked):
        said = tokens_of(q)
        pairs = [f"{a} {b}" for a, b in zip(said, said[1:], strict=False)]
        signals[f"exact{k}"] = F.expr(f"CASE WHEN contains(_low, {quoted(q)}) THEN 1D WHEN contains(_name, {quoted(q)}) THEN 0.8D ELSE 0D END")
        signals[f"phrase{k}"] = F.expr("(" + " + ".join(["0D", *[f"CAST(contains(_low, {quoted(p)}) AS DOUBLE)" for p in pairs]]) + f") * {0.15 / max(len(pairs), 1)!r}D")
        headed = f"exists(split(_low, '\\n'), x -> startswith(x, '#') AND contains(x, {quoted(q)}))"
        signals[f"heading{k}"] = F.expr(f"CASE WHEN contains(_low, {quoted(q)}) AND {headed} THEN 0.1D ELSE 0D END") if said else F.lit(0.0)
    if fuzzy:
        signals["like"] = similarity(asked)(F.col("content"), F.col("_name"))
    rows = cut(once(lowered(docs), **signals).select("doc_id", "stem", *keep, *signals))
    stats = frequencies(rows, terms)
    n = stats["n"]
    df_of = dict(zip(terms, stats["df"], strict=True))
    told = []
    for k, words in enumerate(own):
        weight = {t: max(0.1, (n - (df_of[t] or 1) + 0.5) / ((df_of[t] or 1) + 0.5)) for t in words}
        token = " + ".join(["0D", *[f"CASE WHEN tf{terms.index(t)} > 0 OR nm{terms.index(t)} THEN {weight[t]!r}D ELSE 0D END" for t in words]])
        most = sum(math.log((n - df_of[t] + 0.5) / (df_of[t] + 0.5) + 1.0) for t in words) * (K1 + 1)
        told.append(
            f"named_struct('q', {k}, 'exact', exact{k}, 'token', ({token}) / {sum(weight.values()) or 1.0!r}D, 'bm25', least(1D, {bm25(stats, terms, only=words)} / {most or 1.0!r}D),"
            f" 'fuzzy', {f'like[{k}]' if fuzzy else '0D'}, 'bonus', phrase{k} + heading{k} + recency)"
        )
    x = F.col
    base = F.when(x("exact") > 0, F.greatest("exact", F.least(F.lit(1.0), 0.55 * x("exact") + 0.25 * x("token") + 0.20 * x("bm25")))).otherwise(
        F.least(F.lit(1.0), 0.45 * x("token") + 0.30 * x("bm25") + 0.25 * x("fuzzy"))
    )
    hit = (x("exact") > 0) | (x("token") > 0) | (x("bm25") > 0) | (x("fuzzy") >= 0.3)
    # the array is a generator's input, so each signal is computed once and the test of the hit stays behind it
    hits = rows.select("doc_id", "stem", *keep, F.inline(F.expr(f"array({', '.join(told)})"))).where(hit)
    hits = hits.select("q", "doc_id", "stem", *keep, cents(F.least(F.lit(1.0), base + x("bonus"))).alias("score"))
    best = hits.groupBy("q", "stem").agg(F.max(F.struct("score", (-x("doc_id")).alias("back"), *keep)).alias("b"))
    return best.select("q", (-x("b.back")).alias("doc_id"), "stem", *[f"b.{c}" for c in keep], "b.score")


def composite(docs: DataFrame, query: str, as_of: str, fuzzy: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """``scores`` of one query: ``doc_id, stem, score`` and the columns of ``keep``."""
    return scores(docs, [query], as_of, fuzzy, keep).drop("q")


def similarity(queries: Sequence[str]):
    """Per query the largest difflib ratio of the query and a stripped line or the file name, in that order of operands;
    whole texts, Arrow-vectorised.

    A line is compared only if the characters it shares with the query could beat the best ratio so far, which is exact.
    """
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def ratio(texts: pa.Array, names: pa.Array) -> pa.Array:
        from collections import Counter
        from difflib import SequenceMatcher

        asked = [(q, Counter(q)) for q in queries]
        out = []
        for text, name in zip(texts.to_pylist(), names.to_pylist(), strict=True):
            best = [0.0] * len(asked)
            for line in [*(x.strip() for x in dict.fromkeys((text or "").lower().split("\n"))), name or ""]:
                m = None
                for k, (q, letters) in enumerate(asked):
                    whole = len(q) + len(line)
                    if not whole or 2 * min(len(q), len(line)) <= best[k] * whole or 2 * sum(min(n, line.count(c)) for c, n in letters.items()) <= best[k] * whole:
                        continue
                    m = m or SequenceMatcher(None, "", line)
                    m.set_seq1(q)
                    best[k] = max(best[k], m.ratio())
            out.append(best)
        return pa.array(out, pa.list_(pa.float64()))

    return ratio


def top(hits: DataFrame, k: int) -> DataFrame:
    return hits.orderBy(F.desc("score"), "doc_id").limit(k)


def texts_of(docs: DataFrame, hits: DataFrame, *columns: str) -> DataFrame:
    """``hits`` (a list that was cut to its top) with columns of their documents, read by their ids: the ids reach the
    scan as a filter, and the list is small enough to be broadcast."""
    kept = cut(hits)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    return docs.where(F.col("doc_id").isin(ids)).select("doc_id", *columns).join(F.broadcast(kept), "doc_id")


def search(docs: DataFrame, query: str, as_of: str, top_k: int = 20) -> DataFrame:
    return top(composite(docs, query, as_of).select("doc_id", "score"), top_k)


def search_lists(docs: DataFrame, queries: Sequence[str], as_of: str, top_k: int = 20) -> list[DataFrame]:
    """The list of ``search`` for each query, all of one scan; the lists together are cut once, being small."""
    from pyspark.sql import Window

    w = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
    rows = cut(scores(docs, queries, as_of).select("q", "doc_id", "score").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_k).drop("_r"))
    return [rows.where(F.col("q") == k).select("doc_id", "score") for k in range(len(queries))]


def expanded(docs: DataFrame, query: str, as_of: str, top_k: int = 20, fuzzy: bool = False) -> DataFrame:
    """The query and its keyword variants, scored in one scan; the best score of a document counts."""
    hits = scores(docs, [query, *keyword_variants(query)], as_of, fuzzy)
    return top(hits.groupBy("doc_id").agg(F.max("score").alias("score")), top_k)


def ranked(docs: DataFrame, query: str, as_of: str, top_k: int = 20, floor: float = 0.5) -> DataFrame:
    """A floor that only applies if at least one document clears it."""
    from pyspark.sql import Window

    hits = search(docs, query, as_of, top_k)
    return hits.withColumn("_best", F.max("score").over(Window.partitionBy())).where((F.col("score") >= floor) | (F.col("_best") < floor)).drop("_best")


def precise(docs: DataFrame, query: str, as_of: str, top_k: int = 5, threshold: float = 0.1) -> DataFrame:
    """Plain hits above the threshold; only if there are none, fuzzy hits above half of it."""
    plain = cut(search(docs, query, as_of, top_k).where(F.col("score") >= threshold))
    if plain.limit(1).count():
        return plain
    fuzzy = top(composite(docs, query, as_of, fuzzy=True).select("doc_id", "score"), top_k)
    return fuzzy.where(F.col("score") >= threshold / 2)


def temporal(docs: DataFrame, query: str, as_of: str, hint: str, top_k: int = 20, window_days: int = 30) -> DataFrame:
    """Over-fetch twice ``top_k``, add 0.15 for the very date or up to 0.10 for the nearest date in the window."""
    hits = texts_of(docs, search(docs, query, as_of, 2 * top_k), "content")
    dates = F.transform(F.regexp_extract_all("content", F.lit(r"\d{4}-\d{2}-\d{2}"), F.lit(0)), lambda d: d.try_cast("date"))
    gap = F.array_min(F.transform(F.filter(dates, lambda d: d.isNotNull()), lambda d: F.abs(F.datediff(d, F.lit(hint).cast("date")))))
    near = F.when(gap <= window_days, 0.10 * (1 - gap / window_days)).otherwise(0.0)
    boost = F.when(F.col("content").contains(hint), 0.15).otherwise(F.coalesce(near, F.lit(0.0)))
    return top(hits.select("doc_id", F.least(F.lit(1.0), F.col("score") + boost).alias("score")), top_k)


def lookup(docs: DataFrame, query: str) -> DataFrame:
    """``doc_id, dir, priority``: substring hits in directory order, ending with the first class of two hits or more.

    The gate is the number of hits of the first class: a scan of its own that stops at the second one.
    """
    q = query.lower()
    hits = docs.where(F.lower("content").contains(q) | F.lower(F.translate("stem", "-", " ")).contains(q))
    level = F.when(F.col("dir").isin("entities", "live-notes"), 1).when(F.col("dir").isin("decisions", "meetings", "runbooks"), 2).otherwise(3)
    found = hits.select("doc_id", "dir", level.alias("priority"))
    first = found.where("priority = 1")
    return first if first.limit(2).count() == 2 else found


def gather(docs: DataFrame, recent: int, date: str, tag: str) -> DataFrame:
    """The newest ``recent`` documents, then those with the date, then those with the tag (the order matters)."""
    newest = docs.orderBy(F.desc("mtime"), "doc_id").limit(recent)
    return newest.where((F.col("content").contains(date) | F.col("stem").contains(date)) & F.lower("content").contains(tag)).select("doc_id", "stem")
