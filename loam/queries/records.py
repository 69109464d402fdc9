"""Queries over records in notes, answers and preferences, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import text
from loam.operators import facts, lexical, lifecycle, records, reports, stores
from loam.queries.memory import FV
from loam.queries.reports import _SENT
from loam.queries.retrieval import AS_OF, DOCS, Q, WORDS, composite_sql, top_sql
from loam.sources.tables import spread, table

WHO = "shared-inbox-relay"
DAY = "2024-06-30"
KEYS = ["storage", "quota", "review"]
ANSWER = "the storage quota review was moved"


def _d(s, d):
    return lexical.corpus(spread(table(s, d, "documents")))


def _f(s, d):
    return facts.facts_view(table(s, d, "facts"))


def _answers(s, d):
    """Labels as answers about the names in ids."""
    rows = table(s, d, "nodes", "id", "label", "node_type").where("id is not null")
    return rows.select(F.col("node_type").alias("category"), F.col("label").alias("predicted"), F.regexp_replace(F.regexp_replace("id", r"-\d+$", ""), "-", " ").alias("gold"))


def _runbooks(s, d):
    docs = _d(s, d).where("dir = 'runbooks'")
    return docs.select(F.col("doc_id").alias("id"), F.trim(F.regexp_extract("content", r"(?m)^# ([^\n\r]*)", 1)).alias("pattern"), (F.pmod("doc_id", F.lit(10)) / 10.0).alias("confidence"))


def _fusion(s, d):
    docs = _d(s, d)
    a, b = lexical.search_lists(docs, [Q, "storage quota review"], AS_OF, 30)
    return records.session_fusion(a, b)


QUERIES = {
    "entity_pages": lambda s, d: records.entity_pages(_d(s, d)),
    "changed_since": lambda s, d: records.changed_since(_d(s, d), "2025-06-01"),
    "table_rows": lambda s, d: records.table_rows(_d(s, d)),
    "list_items": lambda s, d: records.list_items(_d(s, d)),
    "inbox_routes": lambda s, d: records.routed_inbox(_d(s, d)),
    "compression_hints": lambda s, d: records.compression_hints(_d(s, d), 1500),
    "page_summaries": lambda s, d: records.page_summaries(_d(s, d), ["Open points", "Notes"]),
    "decision_search": lambda s, d: records.decision_search(_d(s, d), "approved", "2023-01-01", "2025-12-31"),
    "matching_sentences": lambda s, d: records.matching_sentences(reports.sentences(_d(s, d)), KEYS).select("doc_id", "line_no", "sentence_no", "n_hits"),
    "runbook_match": lambda s, d: records.runbook_matches(_runbooks(s, d), "partners logistics", 0.2, 10),
    "attachments": lambda s, d: records.attachments(_d(s, d)),
    "modalities": lambda s, d: records.by_modality(_d(s, d)),
    "document_summaries": lambda s, d: records.document_summaries(_d(s, d)),
    "answer_scores": lambda s, d: records.scored_answers(_answers(s, d)),
    "pref_set": lambda s, d: records.set_preference(_f(s, d), WHO, "role", "archivist", DAY),
    "pref_polarity": lambda s, d: records.preferences_at(_f(s, d), DAY),
    "session_fusion": _fusion,
    "relevant_sessions": lambda s, d: records.relevant_sessions(_d(s, d), "what did the team say about the storage quota"),
    "checked_answer": lambda s, d: records.checked_answer(_d(s, d), ANSWER),
    "chunk_pages": lambda s, d: records.chunk_pages(_d(s, d)).groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars")),
    "similar_titles": lambda s, d: records.similar_titles(_d(s, d), "pabranrusk partners logistics"),
    "last_access": lambda s, d: table(s, d, "events", "user_id", "ts").where("user_id is not null").groupBy("user_id").agg(F.count("ts").alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day")),
    "snapshot_list": lambda s, d: lifecycle.snapshot(_d(s, d), "a").groupBy("snapshot").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("n_chars"), F.countDistinct("hash").alias("n_hashes")),
}

_L = f"{DOCS}, ln AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(content, chr(10)) AS x FROM docs))"
_has = lambda col, cues: " OR ".join(f"contains(lower({col}), '{c.replace(chr(39), chr(39) * 2)}')" for c in cues)
_TAG = "substr(trim(regexp_extract(content, '(?i)(?:tags?|태그):[ \\t]*([^\\n\\r]+)', 1)), 1, 50)"
_NORM = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))"


_GOLD = "regexp_replace(regexp_replace(id, '-\\d+$', ''), '-', ' ', 'g')"


def _section(name):
    r = f"regexp_extract(content, '(?s)## {name}(.*)\\z', 1)"
    return f"string_split(regexp_replace(CASE WHEN contains({r}, chr(10) || '## ') THEN string_split({r}, chr(10) || '## ')[1] WHEN contains({r}, chr(10) || '---') THEN string_split({r}, chr(10) || '---')[1] ELSE {r} END, '^\\s+|\\s+$', '', 'g'), chr(10))"


def _first(name, mark, n):
    return f"list_filter(list_transform({_section(name)}, lambda x: trim(x)), lambda x: starts_with(x, '{mark}'))[1:{n}]"


_MODALITY = "CASE " + " ".join(f"WHEN lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in stores.MODALITIES.items()) + " ELSE 'binary' END"
_CHUNKS = "w AS (SELECT stem, content, list_filter(regexp_split_to_array(content, '[ \\t\\n\\r\\f]+'), lambda w: w <> '') AS w FROM docs), z AS (SELECT *, len(w) AS n, CASE WHEN length(content) < 500 THEN 128 WHEN length(content) <= 2000 THEN 256 ELSE 512 END AS size FROM w), c AS (SELECT *, unnest(generate_series(0, CASE WHEN n <= size THEN 0 ELSE ceil((n - size) / (size - 50)::DOUBLE)::INT END)) AS i FROM z), k AS (SELECT stem AS parent, CASE WHEN n <= size THEN content ELSE list_aggregate(w[i * (size - 50) + 1 : i * (size - 50) + size], 'string_agg', ' ') END AS t FROM c)"
_AW, _SW = text.tokens_of(ANSWER), list(dict.fromkeys(text.tokens_of("what did the team say about the storage quota")))
SQL: dict[str, str] = {
    "entity_pages": f"WITH {DOCS}, l AS (SELECT *, string_split(content, chr(10)) AS l FROM docs WHERE dir IN ('entities', 'live-notes')) SELECT doc_id, stem, len(list_filter(l, lambda x: regexp_matches(x, '^- '))) AS n_bullets, len(list_filter(l, lambda x: regexp_matches(x, '^- \\*\\*\\d{{4}}-\\d{{2}}-\\d{{2}}\\*\\*'))) AS n_timeline, {_TAG} AS tags FROM l",
    "changed_since": f"WITH {DOCS} SELECT doc_id, dir FROM docs WHERE mtime > TIMESTAMP '2025-06-01'",
    "list_items": f"WITH {_L}, i AS (SELECT doc_id, line_no, trim(regexp_extract(regexp_replace(line, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '^[-*]\\s+(?:\\[[\\d\\-]+\\]\\s*)?(.+)$', 1), ' ') AS item FROM ln) SELECT * FROM i WHERE length(item) > 10",
    "inbox_routes": f"WITH {DOCS} SELECT doc_id, CASE " + " ".join(f"WHEN {_has('content', c)} THEN '{k}'" for k, c in records.ROUTES.items()) + " ELSE 'entity' END AS route FROM docs WHERE dir = 'inbox' AND length(regexp_replace(content, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) >= 20",
    "compression_hints": f"WITH {DOCS}, l AS (SELECT doc_id, content, list_transform(string_split(content, chr(10)), lambda x: trim(x, ' ')) AS l FROM docs WHERE length(content) > 1500), n AS (SELECT doc_id, length(content) AS size, len(list_filter(l, lambda x: starts_with(x, '- **') AND contains(substr(x, 5), '**'))) AS t, len(list_filter(l, lambda x: starts_with(x, '- ') AND contains(x, '[Source:'))) AS p FROM l) SELECT doc_id, coalesce(nullif(concat_ws('; ', CASE WHEN t > 20 THEN 'condense timeline (' || t || ')' END, CASE WHEN p > 10 THEN 'merge points (' || p || ')' END, CASE WHEN size > 8000 THEN 'split or archive' END), ''), 'condense') AS hint FROM n",
    "page_summaries": f"WITH {DOCS}, p AS (SELECT doc_id, list_concat({_first('Open points', '- ', 5)}, list_concat({_first('Notes', '- ', 5)}, {_first('Timeline', '- **', 3)})) AS p FROM docs), s AS (SELECT doc_id, substr(list_aggregate(p, 'string_agg', chr(10)), 1, 500) AS summary FROM p) SELECT * FROM s WHERE summary <> ''",
    "decision_search": f"WITH {DOCS} SELECT doc_id, strftime(mtime, '%Y-%m-%d') AS day FROM docs WHERE dir = 'decisions' AND contains(lower(content), 'approved') AND strftime(mtime, '%Y-%m-%d') BETWEEN '2023-01-01' AND '2025-12-31' ORDER BY mtime DESC, doc_id LIMIT 50",
    "matching_sentences": f"WITH {_SENT}, n AS (SELECT doc_id, line_no, sentence_no, {' + '.join(f'contains(lower(sentence), {chr(39)}{w}{chr(39)})::INT' for w in KEYS)} AS n_hits FROM se) SELECT * FROM n WHERE n_hits > 0",
    "modalities": f"WITH {DOCS} SELECT {_MODALITY} AS modality, count(*) AS n, sum(length(content)) AS n_chars FROM docs GROUP BY 1",
    "answer_scores": f"WITH a AS (SELECT coalesce(node_type, '(none)') AS category, label AS p0, {_NORM.format('label')} AS p, {_NORM.format(_GOLD)} AS g FROM nodes WHERE id IS NOT NULL) SELECT coalesce(category, '(all)') AS category, count(*) AS n, avg((p = g)::INT) AS exact, avg((g <> '' AND contains(p, g))::INT) AS contains, avg(({_has('coalesce(p0, chr(32))', records.ABSTENTIONS)})::INT) AS abstained FROM a GROUP BY ROLLUP (category)",
    "pref_set": f"WITH {FV} SELECT key, value, vf, CASE WHEN key = 'role' AND vt IS NULL AND (vf IS NULL OR vf <= '{DAY}') THEN '{DAY}' ELSE vt END AS vt FROM f WHERE entity = '{WHO}' UNION ALL SELECT 'role', 'archivist', '{DAY}', NULL",
    "pref_polarity": f"WITH {FV}, r AS (SELECT entity, trim(value) AS v, lower(trim(value)) IN ({', '.join(repr(x) for x in facts.NEGATIVE_VALUES)}) OR {' OR '.join(f'starts_with(lower(key), {chr(39)}{p}{chr(39)})' for p in facts.NEGATIVE_KEYS)} AS bad FROM f WHERE value IS NOT NULL AND coalesce(vt, '9999') >= '{DAY}' AND (vf IS NULL OR vf <= '{DAY}')), c AS (SELECT *, v <> '' AND length(v) <= 60 AND len(regexp_split_to_array(v, '\\s+')) <= 8 AND length(v) - length(replace(v, '.', '')) < 2 AND length(v) - length(replace(v, ',', '')) < 2 AS clean FROM r) SELECT entity, count(*) FILTER (clean AND NOT bad) AS n_positive, count(*) FILTER (clean AND bad) AS n_negative, count(*) FILTER (NOT clean) AS n_dropped FROM c GROUP BY entity",
    "session_fusion": f"WITH {DOCS}, {composite_sql(Q, 'a0')}, a AS ({top_sql('a0', 30)}), {composite_sql('storage quota review', 'b0')}, b AS ({top_sql('b0', 30)}), u AS (SELECT doc_id, 0.6::DOUBLE * (score / max(score) OVER ()) AS s FROM a UNION ALL SELECT doc_id, 0.4::DOUBLE * (score / max(score) OVER ()) FROM b) SELECT doc_id, sum(s) AS score FROM u GROUP BY doc_id",
    "relevant_sessions": f"WITH {DOCS}, t AS (SELECT doc_id, unnest(list_transform(string_split(content, '[USER]')[2:], lambda x: trim(regexp_extract(x, '(?s)^(.*?)(?:\\[(?:ASSISTANT|SYSTEM)\\]|\\z)', 1)))) AS q FROM docs), w AS (SELECT DISTINCT doc_id, unnest({WORDS.format('q')}) AS w FROM t), c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (w IN {tuple(_SW)}) AS met FROM w GROUP BY doc_id) SELECT doc_id, met / (n + {len(_SW)} - met)::DOUBLE AS score FROM c WHERE met > 0 ORDER BY score DESC, doc_id LIMIT 20",
    "checked_answer": f"WITH {DOCS}, c AS (SELECT doc_id, len(list_intersect(list_distinct({WORDS.format('content')}), {_AW})) / {float(len(_AW))}::DOUBLE AS coverage FROM docs) SELECT * FROM c WHERE coverage >= 0.5",
    "chunk_pages": f"WITH {DOCS}, {_CHUNKS} SELECT parent, count(*) AS n, sum(length(t)) AS n_chars FROM k GROUP BY parent",
    "similar_titles": f"WITH {DOCS}, w AS (SELECT doc_id, list_distinct({WORDS.format('replace(stem, chr(45), chr(32))')}) AS w FROM docs), s AS (SELECT doc_id, len(list_intersect(w, ['pabranrusk', 'partners', 'logistics'])) / len(list_distinct(list_concat(w, ['pabranrusk', 'partners', 'logistics'])))::DOUBLE AS score FROM w) SELECT * FROM s WHERE score >= 0.1",
    "last_access": "SELECT user_id, count(ts) AS n, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events WHERE user_id IS NOT NULL GROUP BY 1",
    "snapshot_list": f"WITH {DOCS} SELECT 'a' AS snapshot, count(*) AS n, sum(length(content)) AS n_chars, count(DISTINCT substr(sha256(content), 1, 12)) AS n_hashes FROM docs",
}
