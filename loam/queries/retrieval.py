"""Retrieval queries over ``documents`` and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loam.functions import text
from loam.operators import fusion, lexical, ranking, routing
from loam.session import checkpoint_folder
from loam.sources.tables import spread, table

Q = "choir rehearsal plan budget"
AS_OF = "2026-01-01"
HINT = "2024-05-10"
WORDS = "list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) > 1)"
CENTS = "floor(({0}) * 100 + 0.5) / 100.0"
DOCS = (
    "docs AS (SELECT doc_id, path, coalesce(source, 'base') AS dir, regexp_replace(list_extract(string_split(path, '/'), -1), '\\.md$', '') AS stem,"
    " coalesce(text, '') AS content, mtime, entity FROM documents)"
)


def docs(spark, d):
    return lexical.corpus(spread(table(spark, d, "documents")))


def counted_sql(terms: list[str], name: str = "c") -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    return (
        f"{name}w AS (SELECT *, {WORDS.format('content')} AS w FROM docs), {name}0 AS (SELECT * EXCLUDE (w), len(w) AS dl, {tf} FROM {name}w), "
        f"{name}s AS (SELECT count(*) AS n, sum(dl)::DOUBLE / greatest(count(*), 1) AS avgdl, "
        + ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
        + f" FROM {name}0), {name} AS (SELECT * FROM {name}0, {name}s)"
    )


def _in_name(term: str) -> str:
    return f"list_contains(regexp_extract_all(lower(replace(stem, '-', ' ')), '[\\p{{L}}\\p{{N}}_]+'), '{term}')"


def bm25_sql(terms: list[str], names: bool) -> str:
    parts = []
    for i, t in enumerate(terms):
        tf = f"(CASE WHEN tf{i} = 0 AND {_in_name(t)} THEN 1 ELSE tf{i} END)" if names else f"tf{i}"
        parts.append(f"(CASE WHEN {tf} > 0 THEN ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * {tf}::DOUBLE * 2.5 / ({tf}::DOUBLE + 1.5 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END)")
    return " + ".join(parts)


def composite_sql(query: str, name: str) -> str:
    """CTEs ending in ``name(doc_id, content, dir, mtime, score)``."""
    words = text.tokens_of(query)
    terms = list(dict.fromkeys(words))
    q = query.lower()
    weight = [f"greatest(0.1, (n - greatest(df{i}, 1) + 0.5) / (greatest(df{i}, 1) + 0.5))" for i in range(len(terms))]
    stem = "lower(replace(stem, '-', ' '))"
    token = "(" + " + ".join(f"CASE WHEN tf{i} > 0 OR {_in_name(t)} THEN {weight[i]} ELSE 0 END" for i, t in enumerate(terms)) + f") / ({' + '.join(weight)})"
    most = "(" + " + ".join(f"ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1)" for i in range(len(terms))) + ") * 2.5"
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    phrase = "(" + (" + ".join(f"contains(lower(content), '{p}')::INT" for p in pairs) or "0") + f") * 0.15::DOUBLE / {max(len(pairs), 1)}"
    heading = f"CASE WHEN len(list_filter(string_split(lower(content), chr(10)), lambda x: starts_with(x, '#') AND contains(x, '{q}'))) > 0 THEN 0.1 ELSE 0 END"
    age = f"date_diff('day', try_cast(list_max(regexp_extract_all(content, '\\*\\*(\\d{{4}}-\\d{{2}}-\\d{{2}})\\*\\*', 1)) AS DATE), DATE '{AS_OF}')"
    return (
        counted_sql(terms, f"{name}c")
        + f", {name}1 AS (SELECT doc_id, content, dir, mtime, stem, (CASE WHEN contains(lower(content), '{q}') THEN 1.0 WHEN contains({stem}, '{q}') THEN 0.8 ELSE 0 END)::DOUBLE AS exact,"
        f" ({token})::DOUBLE AS token, least(1, ({bm25_sql(terms, True)}) / ({most}))::DOUBLE AS bm, ({phrase} + {heading} + CASE WHEN {age} < 7 THEN 0.05 WHEN {age} < 30 THEN 0.02 ELSE 0 END)::DOUBLE AS bonus FROM {name}c)"
        f", {name}2 AS (SELECT doc_id, content, dir, mtime, stem, {CENTS.format('least(1::DOUBLE, (CASE WHEN exact > 0 THEN greatest(exact, least(1::DOUBLE, 0.55::DOUBLE * exact + 0.25::DOUBLE * token + 0.20::DOUBLE * bm)) ELSE least(1::DOUBLE, 0.45::DOUBLE * token + 0.30::DOUBLE * bm) END) + bonus)')} AS score"
        f" FROM {name}1 WHERE exact > 0 OR token > 0 OR bm > 0)"
        f", {name} AS (SELECT * EXCLUDE (stem) FROM {name}2 QUALIFY row_number() OVER (PARTITION BY stem ORDER BY score DESC, doc_id) = 1)"
    )


def top_sql(source: str, k: int, columns: str = "doc_id, score") -> str:
    return f"SELECT {columns} FROM {source} ORDER BY score DESC, doc_id LIMIT {k}"


def variants_sql(query: str, k: int, name: str) -> str:
    queries = [query, *text.keyword_variants(query)]
    parts = ", ".join(composite_sql(q, f"{name}v{i}") for i, q in enumerate(queries))
    union = " UNION ALL ".join(f"SELECT doc_id, score FROM {name}v{i}" for i in range(len(queries)))
    return f"{parts}, {name}u AS (SELECT doc_id, max(score) AS score FROM ({union}) GROUP BY doc_id), {name} AS ({top_sql(name + 'u', k)})"


def snippet(hits, query=Q):
    return hits.withColumn("snippet", text.snippet(F.col("content"), text.tokens_of(query), phrase=query.lower()))


def hits(spark, d, query=Q, k=40):
    found = docs(spark, d)
    return lexical.texts_of(found, lexical.search(found, query, AS_OF, k), "content", "dir", "stem")


def _postings(spark, d):
    """``bm25_topk`` from postings that are written first, below the folder for checkpoints."""
    folder = f"{checkpoint_folder(spark)}/postings-{uuid.uuid4().hex}"
    lexical.write_postings(docs(spark, d), folder, 16)
    return lexical.bm25_postings(spark, folder, Q, buckets=16)


def _hits_sql(query=Q, k=40):
    return f"WITH {DOCS}, {composite_sql(query, 'h0')}, h AS ({top_sql('h0', k, '*')})"


def _class_sql() -> tuple[str, str]:
    simple = " ".join(f"WHEN {' OR '.join(f'contains(lower(question), {chr(39)}{c}{chr(39)})' for c in cues)} THEN '{k}'" for k, cues in routing.SIMPLE.items())
    typed = " ".join(f"WHEN regexp_matches(lower(question), '{routing.pattern_of(cues)}') THEN '{k}'" for k, cues in routing.TYPES.items())
    return f"CASE {simple} ELSE 'fact' END", f"CASE {typed} ELSE 'general' END"


TURNS_SQL = f"WITH {DOCS}, t AS (SELECT doc_id, list_transform(string_split(content, '[USER]')[2:], lambda x: trim(regexp_extract(x, '(?s)^(.*?)(?:\\[(?:ASSISTANT|SYSTEM)\\]|\\z)', 1))) AS q FROM docs), u AS (SELECT doc_id, unnest(q) AS question, generate_subscripts(q, 1) - 1 AS pos FROM t)"
LISTS = [Q, "storage quota review", "garden survey"]


def _bonus_sql(kind):
    low, dated, opened = "lower(content)", "regexp_matches(content, '\\d{4}-\\d{2}-\\d{2}')", "regexp_matches(content, 'valid:\\[[^\\]\\)]*\\.\\.\\)')"
    return {
        "temporal_reasoning": f"(CASE WHEN regexp_matches({low}, '{ranking.ORDER}') THEN 0.15 ELSE 0 END) + (CASE WHEN {dated} THEN 0.10 WHEN regexp_matches({low}, '{ranking.YEAR}') THEN 0.05 ELSE 0 END) + (CASE WHEN {dated} THEN 0.05 ELSE 0 END)",
        "knowledge_update": f"(CASE WHEN {opened} THEN 0.20 WHEN {dated} THEN 0.10 ELSE 0 END) + (CASE WHEN regexp_matches({low}, '{ranking.NOW}') THEN 0.05 ELSE 0 END)",
        "preference": f"(CASE WHEN regexp_matches({low}, '{ranking.LIKES}') THEN 0.25 ELSE 0 END)",
        "counting": f"(CASE WHEN regexp_matches({low}, '{ranking.BOUGHT}') THEN 0.30 ELSE 0 END) - (CASE WHEN regexp_matches({low}, '{ranking.INTENT.replace(chr(39), chr(39) * 2)}') THEN 0.15 ELSE 0 END)",
    }[kind]


QUERIES = {
    "corpus_stats": lambda s, d: lexical.corpus_stats(docs(s, d)),
    "term_stats": lambda s, d: lexical.term_stats(docs(s, d)),
    "bm25_topk": lambda s, d: lexical.bm25_topk(docs(s, d), Q),
    "bm25_postings": _postings,
    "composite_search": lambda s, d: lexical.search(docs(s, d), Q, AS_OF, 50),
    "expanded_search": lambda s, d: lexical.expanded(docs(s, d), "who moved the storage quota review in Venmark", AS_OF, 30),
    "score_floor": lambda s, d: lexical.ranked(docs(s, d), Q, AS_OF, 30, 0.5),
    "precise_search": lambda s, d: lexical.precise(docs(s, d), "storage quota", AS_OF, 10),
    "fuzzy_search": lambda s, d: lexical.top(lexical.composite(docs(s, d), "storge qouta", AS_OF, fuzzy=True).select("doc_id", "score"), 20),
    "temporal_search": lambda s, d: lexical.temporal(docs(s, d), Q, AS_OF, HINT, 25),
    "smart_search": lambda s, d: routing.smart(docs(s, d), "when was the garden survey", AS_OF, HINT, 20),
    "directory_lookup": lambda s, d: lexical.lookup(docs(s, d), "ferry timetable"),
    "recent_gather": lambda s, d: lexical.gather(docs(s, d), 400, "2024", "people"),
    "multi_query_rrf": lambda s, d: fusion.rrf(lexical.search_lists(docs(s, d), LISTS, AS_OF, 30)),
    "weighted_rrf": lambda s, d: fusion.rrf(lexical.search_lists(docs(s, d), LISTS[:2], AS_OF, 30), weights=[0.5, 0.5]),
    "max_merge": lambda s, d: fusion.maximum(lexical.search_lists(docs(s, d), LISTS, AS_OF, 30)),
    "weighted_blend": lambda s, d: fusion.blend(lexical.search_lists(docs(s, d), LISTS, AS_OF, 30), [0.5, 0.3, 0.2]),
    "timeline_search": lambda s, d: routing.timeline(docs(s, d), Q, AS_OF, 40),
    "latest_search": lambda s, d: routing.latest(docs(s, d), Q, AS_OF, 30),
    "preference_search": lambda s, d: routing.preference(docs(s, d), Q, AS_OF, 40),
    "counting_sweep": lambda s, d: routing.counting(docs(s, d), table(s, d, "edges", "from_id", "to_id"), "how many storage quota reviews", AS_OF),
    "classify_questions": lambda s, d: routing.user_turns(docs(s, d)).select("doc_id", "pos", routing.classify_simple(F.col("question")).alias("simple_class"), routing.classify(F.col("question")).alias("question_type")),
    "confidence_bucket": lambda s, d: snippet(hits(s, d)).select("doc_id", "score", ranking.confidence(F.col("score"), F.col("snippet")).alias("confidence"), "snippet"),
    "context_budget": lambda s, d: ranking.budget(snippet(hits(s, d)), 1500),
    "compress_select": lambda s, d: ranking.compress(snippet(hits(s, d)), Q, 3000),
    **{f"rerank_{k}": (lambda s, d, k=k: ranking.rerank(hits(s, d), k)) for k in ("temporal_reasoning", "knowledge_update", "preference", "counting")},
}


def _rrf_sql(weights):
    parts = ", ".join(composite_sql(q, f"l{i}x") + f", l{i} AS ({top_sql(f'l{i}x', 30)})" for i, q in enumerate(LISTS[: len(weights)]))
    union = " UNION ALL ".join(f"SELECT doc_id, {w} / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS x FROM l{i}" for i, w in enumerate(weights))
    return f"WITH {DOCS}, {parts} SELECT doc_id, sum(x) AS rrf_score, count(*) AS n_lists FROM ({union}) GROUP BY doc_id"


def _lists_sql(select):
    parts = ", ".join(composite_sql(q, f"l{i}x") + f", l{i} AS ({top_sql(f'l{i}x', 30)})" for i, q in enumerate(LISTS))
    union = " UNION ALL ".join(f"SELECT doc_id, score, {i} AS p FROM l{i}" for i in range(3))
    return f"WITH {DOCS}, {parts} SELECT doc_id, {select} AS score FROM ({union}) GROUP BY doc_id"


_TEMPORAL_Q = "when was the garden survey"


def _temporal_sql(query, k):
    gap = f"list_min(list_transform(list_filter(list_transform(regexp_extract_all(content, '\\d{{4}}-\\d{{2}}-\\d{{2}}'), lambda x: try_cast(x AS DATE)), lambda x: x IS NOT NULL), lambda x: abs(date_diff('day', x, DATE '{HINT}'))))"
    return f"{_hits_sql(query, 2 * k)}, b AS (SELECT doc_id, least(1::DOUBLE, score + (CASE WHEN contains(content, '{HINT}') THEN 0.15 WHEN {gap} <= 30 THEN 0.10::DOUBLE * (1 - {gap} / 30.0) ELSE 0 END)::DOUBLE) AS score FROM h) {top_sql('b', k)}"


_SNIP = "snippet"


def _snip_sql(source: str, query: str) -> str:
    """CTEs ending in ``sn``: ``source`` with what a hit shows."""
    terms, q = list(dict.fromkeys(text.tokens_of(query))), query.lower()
    return (
        f"s0 AS (SELECT *, string_split(content, chr(10)) AS l FROM {source}), s1 AS (SELECT *, list_transform(l, lambda x: len(list_intersect(list_distinct({WORDS.format('x')}), {terms}))) AS n, list_position(list_transform(l, lambda x: contains(lower(x), '{q}')), true) AS p FROM s0)"
        ", s2 AS (SELECT * EXCLUDE (n, p), CASE WHEN p > 0 THEN p WHEN list_max(n) > 0 THEN list_position(n, list_max(n)) END AS i FROM s1)"
        ", sn AS (SELECT * EXCLUDE (l, i), CASE WHEN i IS NULL THEN '' ELSE coalesce(substr(list_aggregate(list_filter(list_transform(l[greatest(1, i - 3) : i + 3], lambda x: regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lambda x: x <> ''), 'string_agg', ' | '), 1, 200), '') END AS snippet FROM s2)"
    )


_CONF = "CASE WHEN regexp_matches(lower({0}), '" + ranking.INTENT.replace("'", "''") + "') THEN 'low' WHEN score > 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END"
_LEVEL = "CASE WHEN dir IN ('entities', 'live-notes') THEN 1 WHEN dir IN ('decisions', 'meetings', 'runbooks') THEN 2 ELSE 3 END"
SQL: dict[str, str] = {
    "corpus_stats": f"WITH {DOCS} SELECT count(*) AS n_docs, avg(len({WORDS.format('content')})) AS avg_tokens FROM docs",
    "term_stats": f"WITH {DOCS}, t AS (SELECT doc_id, unnest({WORDS.format('content')}) AS term FROM docs) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS n FROM t GROUP BY term",
    "bm25_topk": f"WITH {DOCS}, {counted_sql(text.tokens_of(Q))}, s AS (SELECT doc_id, {bm25_sql(text.tokens_of(Q), False)} AS score FROM c) SELECT doc_id, score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20",
    "bm25_postings": f"WITH {DOCS}, {counted_sql(text.tokens_of(Q))}, s AS (SELECT doc_id, {bm25_sql(text.tokens_of(Q), False)} AS score FROM c) SELECT doc_id, score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20",
    "composite_search": f"WITH {DOCS}, {composite_sql(Q, 'h')} {top_sql('h', 50)}",
    "expanded_search": f"WITH {DOCS}, {variants_sql('who moved the storage quota review in Venmark', 30, 'e')} SELECT * FROM e",
    "score_floor": f"{_hits_sql(Q, 30)} SELECT doc_id, score FROM (SELECT *, max(score) OVER () AS best FROM h) WHERE score >= 0.5 OR best < 0.5",
    "precise_search": f"{_hits_sql('storage quota', 10)} SELECT doc_id, score FROM h WHERE score >= 0.1",
    "temporal_search": _temporal_sql(Q, 25),
    "smart_search": _temporal_sql(_TEMPORAL_Q, 20),
    "directory_lookup": f"WITH {DOCS}, f AS (SELECT doc_id, dir, {_LEVEL} AS priority FROM docs WHERE contains(lower(content), 'ferry timetable') OR contains(lower(replace(stem, '-', ' ')), 'ferry timetable')) SELECT doc_id, dir, priority FROM (SELECT *, sum((priority = 1)::INT) OVER () AS h FROM f) WHERE priority = 1 OR h < 2",
    "recent_gather": f"WITH {DOCS}, r AS (SELECT * FROM docs ORDER BY mtime DESC, doc_id LIMIT 400) SELECT doc_id, stem FROM r WHERE (contains(content, '2024') OR contains(stem, '2024')) AND contains(lower(content), 'people')",
    "multi_query_rrf": _rrf_sql(["1.0::DOUBLE"] * 3),
    "weighted_rrf": _rrf_sql(["0.5::DOUBLE"] * 2),
    "max_merge": _lists_sql("max(score)"),
    "weighted_blend": _lists_sql("coalesce(max(score) FILTER (p = 0), 0) * 0.5 + coalesce(max(score) FILTER (p = 1), 0) * 0.3::DOUBLE + coalesce(max(score) FILTER (p = 2), 0) * 0.2::DOUBLE"),
    "timeline_search": f"{_hits_sql(Q, 40)}, f AS (SELECT doc_id, score, list_min(regexp_extract_all(content, '\\d{{4}}-\\d{{2}}-\\d{{2}}')) AS first_date FROM h) SELECT *, row_number() OVER (ORDER BY first_date ASC NULLS LAST, score DESC, doc_id) AS pos FROM f",
    "latest_search": f"WITH {DOCS}, {variants_sql(Q, 30, 'e')}, j AS (SELECT e.doc_id, score, epoch_us(mtime) AS m FROM e JOIN docs ON e.doc_id = docs.doc_id) SELECT doc_id, score + 0.20::DOUBLE * (CASE WHEN max(m) OVER () > min(m) OVER () THEN (m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()) ELSE 0 END) AS score FROM j",
    "preference_search": f"{_hits_sql(Q, 40)} SELECT doc_id, score + least(0.25::DOUBLE, 0.05::DOUBLE * ({' + '.join(f'contains(lower(content), {chr(39)}{w}{chr(39)})::INT' for w in routing.LIKING)})) AS score FROM h",
    "classify_questions": f"{TURNS_SQL} SELECT doc_id, pos, {_class_sql()[0]} AS simple_class, {_class_sql()[1]} AS question_type FROM u",
    "confidence_bucket": f"{_hits_sql()}, {_snip_sql('h', Q)} SELECT doc_id, score, {_CONF.format('snippet')} AS confidence, snippet FROM sn",
    "context_budget": f"{_hits_sql()}, {_snip_sql('h', Q)}, b AS (SELECT doc_id, score, CASE WHEN snippet = '' THEN 0 ELSE greatest(1, length({_SNIP}) // 4) END AS n_tokens FROM sn), r AS (SELECT doc_id, n_tokens, row_number() OVER w AS pos, sum(n_tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM b WINDOW w AS (ORDER BY score DESC, doc_id)) SELECT * FROM r WHERE used <= 1500 OR pos = 1",
    "compress_select": f"{_hits_sql()}, {_snip_sql('h', Q)}, p AS (SELECT doc_id, score + 0.5 * (len(list_intersect(list_distinct({WORDS.format(_SNIP)}), {text.tokens_of(Q)})) / {len(text.tokens_of(Q))}.0) + (CASE WHEN regexp_matches({_SNIP}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 0.15 ELSE 0 END)::DOUBLE + (CASE {_CONF.format(_SNIP)} WHEN 'high' THEN 0.20 WHEN 'medium' THEN 0.05 ELSE -0.10 END)::DOUBLE AS priority, lower(substr(snippet, 1, 80)) AS key, least(length({_SNIP}), 220) AS n FROM sn WHERE snippet <> ''), k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY key ORDER BY priority DESC, doc_id) = 1), r AS (SELECT doc_id, priority, row_number() OVER w AS pos, sum(n + 1) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM k WINDOW w AS (ORDER BY priority DESC, doc_id)) SELECT * FROM r WHERE used <= 3000 OR pos = 1",
    **{
        f"rerank_{k}": f"{_hits_sql()}, r AS (SELECT doc_id, score + ({_bonus_sql(k)})::DOUBLE AS score, list_max(regexp_extract_all(content, '\\d{{4}}-\\d{{2}}-\\d{{2}}')) AS date FROM h) SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, {'date DESC NULLS LAST, ' if k == 'temporal_reasoning' else ''}doc_id) AS pos FROM r"
        for k in ("temporal_reasoning", "knowledge_update", "preference", "counting")
    },
}
