"""Queries of strategies, rendering, merged searches, conflicts and consolidation, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import text
from loam.operators import context, extract, facts, graph, lexical, ranking, routing
from loam.queries.memory import _NOW, DAY, EV, FV
from loam.queries.retrieval import _CONF, AS_OF, DOCS, Q, TURNS_SQL, _hits_sql, _snip_sql, composite_sql, hits, snippet, top_sql, variants_sql
from loam.sources.tables import spread, table

UPDATE = "what is the latest storage quota"
NEW_FACT = "Rosa Tenfilrusk approved the storage quota"
PATHS = "What does the Shared Inbox Relay know"
WHO = "shared-inbox-relay"


def _d(s, d):
    return lexical.corpus(spread(table(s, d, "documents")))


def _f(s, d):
    return facts.facts_view(table(s, d, "facts"))


def _e(s, d):
    return graph.edges_view(table(s, d, "edges"))


def _incidents(s, d):
    ev = table(s, d, "events", "event_id", "ts", "event_type", "props").where("event_type = 'error'")
    return ev.select(F.col("event_id").alias("id"), F.concat_ws(" ", "event_type", "props").alias("text"), F.col("ts").alias("at"))


def _rendered(s, d):
    shown = snippet(hits(s, d)).withColumn("confidence", ranking.confidence(F.col("score"), F.col("snippet")))
    return context.rendered(shown)


def _annotated(s, d):
    rows = _f(s, d).where("value is not null")
    recorded = F.nullif("recorded", F.lit(""))
    return rows.select("entity", "key", "line_no", context.annotated(F.col("value"), F.col("vf"), F.col("vt"), recorded).alias("line"))


QUERIES = {
    "multi_session_flags": lambda s, d: routing.user_turns(_d(s, d)).select("doc_id", "pos", context.spans_sessions(F.col("question")).alias("spans")),
    "dispatch_update": lambda s, d: context.dispatched(_d(s, d), table(s, d, "edges"), _f(s, d), UPDATE, AS_OF, 10),
    "dispatch_general": lambda s, d: context.dispatched(_d(s, d), table(s, d, "edges"), _f(s, d), "storge qouta", AS_OF, 10),
    "rendered_hits": _rendered,
    "annotated_facts": _annotated,
    "prepared_context": lambda s, d: context.prepared(_d(s, d), Q, AS_OF, "temporal_reasoning"),
    "query_index": lambda s, d: context.disclosed(_d(s, d), "ferry timetable", 1),
    "query_headings": lambda s, d: context.disclosed(_d(s, d), "ferry timetable", 2),
    "hierarchical_search": lambda s, d: context.hierarchical(_d(s, d), "originals", Q, AS_OF, 12),
    "graph_paths": lambda s, d: context.graph_paths(_e(s, d), _d(s, d), PATHS, AS_OF, 30),
    "evidence_first": lambda s, d: context.evidence_first(_d(s, d), _incidents(s, d), "storage quota", AS_OF, 25),
    "preference_reasons": lambda s, d: context.preference_reasons(_e(s, d), WHO, "which institute or foundation", 2),
    "conflicts_of_fact": lambda s, d: context.conflicting(extract.bullet_facts(_d(s, d)), NEW_FACT, 0.4),
    "fact_settle": lambda s, d: context.settled(_f(s, d)),
    "consolidate": lambda s, d: context.consolidated(_f(s, d), table(s, d, "nodes"), _e(s, d), table(s, d, "documents"), DAY),
    "health_grade": lambda s, d: context.health(_d(s, d), _f(s, d), table(s, d, "nodes"), AS_OF),
    "graph_similar_all": lambda s, d: context.similar_all(table(s, d, "nodes", "node_no", "id", "label")),
    "search_rrf": lambda s, d: context.fused(_d(s, d), "who moved the storage quota review in Venmark", AS_OF, 20),
}

_SPANS = " OR ".join(f"contains(lower(question), '{p}')" for p in context.SPANNING) + r" OR regexp_matches(lower(question), '(?:how\s+many|how\s+often|얼마나).*(?:in\s+(?:the\s+)?(?:past|last)\s+\d+\s+(?:day|week|month|year)s?|지난\s*\d+\s*(?:일|주|개월|년))')"
_W = text.tokens_of(Q)
_BASE = "length(x) > 10 AND NOT regexp_matches(x, '^(?:#|---|tier:|tags:|source:|updated:|confidence:|>|\\||```)')"
_TAGS = "substr(trim(regexp_extract(content, '(?i)(?:tags?|태그):[ \\t]*([^\\n\\r]+)', 1)), 1, 50)"
_FOUND = "fo AS (SELECT * FROM docs WHERE contains(lower(content), 'ferry timetable') OR contains(lower(stem), 'ferry timetable'))"
_SETTLED = (
    "k AS (SELECT * FROM f WHERE value IS NOT NULL), b AS (SELECT entity, key, value AS wv, vf AS bf, vt AS bt FROM k QUALIFY row_number() OVER (PARTITION BY entity, key ORDER BY recorded DESC, coalesce(vf, '') DESC, line_no, value DESC, vf NULLS FIRST, vt DESC NULLS LAST) = 1),"
    " se AS (SELECT k.entity, k.key, k.value, k.vf, k.line_no, b.bf AS closed_to, b.wv AS winner FROM k JOIN b ON k.entity = b.entity AND k.key = b.key WHERE k.value <> b.wv AND coalesce(k.vf, '0000') <= coalesce(b.bt, '9999') AND coalesce(b.bf, '0000') <= coalesce(k.vt, '9999'))"
)
_ORPHANS = "SELECT DISTINCT lower(trim(id)) AS id FROM nodes WHERE id IS NOT NULL AND lower(trim(id)) NOT IN (SELECT from_id FROM e) AND lower(trim(id)) NOT IN (SELECT to_id FROM e) AND lower(trim(id)) NOT IN (SELECT lower(trim(entity)) FROM documents WHERE entity IS NOT NULL)"
_LABEL = "l AS (SELECT id, lower(min(label)) AS t FROM nodes WHERE id IS NOT NULL AND label IS NOT NULL GROUP BY id), c AS (SELECT count(*) AS n FROM l), x AS (SELECT id, substr(t, i, 2) AS g, count(*) AS tf FROM (SELECT id, t, unnest(generate_series(1, length(t) - 1)) AS i FROM l) GROUP BY ALL), d AS (SELECT g, ln((any_value(n) + 2) / (count(*) + 1)) + 1 AS idf FROM x, c GROUP BY g), v AS (SELECT x.id, x.g, tf * idf AS w FROM x JOIN d ON x.g = d.g), m AS (SELECT id, sqrt(sum(w * w)) AS norm FROM v GROUP BY id)"
_VARIANTS = [Q0 := "who moved the storage quota review in Venmark", *text.keyword_variants(Q0)]
_NOTES = ", ".join(composite_sql(q, f"l{i}x") + f", l{i} AS ({top_sql(f'l{i}x', 60)})" for i, q in enumerate(_VARIANTS))
SQL: dict[str, str] = {
    "multi_session_flags": f"{TURNS_SQL} SELECT doc_id, pos, {_SPANS} AS spans FROM u",
    "dispatch_update": f"WITH {DOCS}, {variants_sql(UPDATE, 30, 'e')}, j AS (SELECT e.doc_id, score, epoch_us(mtime) AS m FROM e JOIN docs ON e.doc_id = docs.doc_id), g AS (SELECT doc_id, score + 0.20::DOUBLE * (CASE WHEN max(m) OVER () > min(m) OVER () THEN (m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()) ELSE 0 END) AS score FROM j) SELECT doc_id, score, 'knowledge_update' AS question_type, 'knowledge_update' AS strategy FROM g ORDER BY score DESC, doc_id LIMIT 10",
    "rendered_hits": (
        f"{_hits_sql(Q, 40).replace('EXCLUDE (stem)', '')}, {_snip_sql('h', Q)}, r AS (SELECT doc_id, score, stem, replace(trim(snippet), chr(10), ' ') AS t, snippet, {_CONF.format('snippet')} AS conf FROM sn)"
        f", b AS (SELECT conf = 'low' AS low, score, doc_id, '[' || conf || ' confidence] ' || stem || CASE WHEN t <> '' THEN ' — ' || CASE WHEN length(t) > 220 THEN rtrim(substr(t, 1, 219)) || '…' ELSE t END ELSE '' END || CASE WHEN conf = 'low' AND regexp_matches(lower(snippet), '{ranking.INTENT.replace(chr(39), chr(39) * 2)}') THEN ' (might indicate acquisition intent)' ELSE '' END AS line FROM r)"
        ", a AS (SELECT * FROM b UNION ALL SELECT * FROM (SELECT true, 'inf'::DOUBLE, -1, '--- low confidence (potential / inferred) ---' FROM b WHERE low LIMIT 1)) SELECT row_number() OVER (ORDER BY low, score DESC, doc_id) AS pos, line FROM a"
    ),
    "annotated_facts": f"WITH {FV}, t AS (SELECT entity, key, line_no, value, vf, nullif(recorded, '') AS r, vf || ' ~ ' || coalesce(nullif(vt, ''), 'present') AS span FROM f WHERE value IS NOT NULL), g AS (SELECT *, CASE WHEN vf IS NOT NULL AND r IS NOT NULL AND r <> vf THEN '[recorded: ' || r || ', valid: ' || span || ']' WHEN vf IS NOT NULL THEN '[' || span || ']' WHEN r IS NOT NULL THEN '[recorded: ' || r || ']' END AS tag FROM t) SELECT entity, key, line_no, CASE WHEN tag IS NULL THEN value ELSE trim(tag || ' ' || value) END AS line FROM g",
    "query_index": f"WITH {DOCS}, {_FOUND} SELECT doc_id, strftime(mtime, '%Y-%m-%d') AS day, {_TAGS} AS tags, substr(coalesce(list_filter(string_split(content, chr(10)), lambda x: {_BASE})[1], ''), 1, 100) AS summary FROM fo",
    "query_headings": f"WITH {DOCS}, {_FOUND}, x AS (SELECT doc_id, regexp_extract_all(content, '(?m)^(#{{1,3}} [^\\n]*)', 1) AS h FROM fo) SELECT doc_id, generate_subscripts(h, 1)::INT - 1 AS pos, unnest(h) AS heading FROM x",
    "hierarchical_search": f"WITH {DOCS}, {composite_sql(Q, 'c')}, o AS (SELECT doc_id, substr(content, 1, 80) AS key, ({' + '.join(f'contains(lower(content), {chr(39)}{w}{chr(39)})::INT' for w in _W)}) / {float(len(_W))}::DOUBLE AS score FROM docs WHERE dir = 'originals'), a AS (SELECT doc_id, key, score, 1 AS pass FROM o WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 12), b AS (SELECT doc_id, substr(content, 1, 80) AS key, score, 2 AS pass FROM c WHERE score >= 0.1 ORDER BY score DESC, doc_id LIMIT 12), u AS (SELECT * FROM a UNION ALL SELECT * FROM b), k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY pass, score DESC, doc_id) = 1) SELECT doc_id, pass, score FROM k ORDER BY pass, score DESC, doc_id LIMIT 12",
    "evidence_first": (
        f"WITH {DOCS}, {composite_sql('storage quota', 'c')}, a AS (SELECT 'memory' AS source, doc_id::VARCHAR AS key, score, NULL::TIMESTAMP AS t0 FROM c ORDER BY score DESC, doc_id LIMIT 25), b AS (SELECT 'decision' AS source, doc_id::VARCHAR AS key, NULL::DOUBLE AS score, mtime::TIMESTAMP AS t0 FROM docs WHERE dir = 'decisions' AND contains(lower(content), 'storage quota') ORDER BY t0 DESC, key LIMIT 25)"
        ", i AS (SELECT 'incident' AS source, event_id::VARCHAR AS key, NULL::DOUBLE AS score, ts::TIMESTAMP AS t0 FROM events WHERE event_type = 'error' AND contains(lower(concat_ws(' ', event_type, props)), 'storage quota') ORDER BY t0 DESC, key LIMIT 25), u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM i)"
        " SELECT row_number() OVER (ORDER BY score DESC NULLS LAST, t0 DESC NULLS LAST, source, key) AS pos, source, key, score, strftime(t0, '%Y-%m-%d') AS day FROM u QUALIFY pos <= 25"
    ),
    "preference_reasons": f"WITH {EV}, a AS (SELECT DISTINCT from_id, relation, to_id, 1 AS depth FROM e WHERE from_id = '{WHO}'), b AS (SELECT DISTINCT e.from_id, e.relation, e.to_id, 2 AS depth FROM e WHERE from_id IN (SELECT to_id FROM a) AND from_id <> '{WHO}'), r AS (SELECT to_id AS target, relation, min(depth) AS depth FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE contains(to_id, 'which') OR contains(to_id, 'institute') OR contains(to_id, 'foundation') GROUP BY 1, 2), y AS (SELECT DISTINCT from_id, to_id FROM e WHERE relation = 'because_of') SELECT target, relation, depth, count(y.to_id) AS n_reasons, min(y.to_id) AS first_reason FROM r LEFT JOIN y ON target = y.from_id GROUP BY ALL",
    "fact_settle": f"WITH {FV}, {_SETTLED} SELECT * FROM se",
    "consolidate": (
        f"WITH {FV}, {EV}, {_SETTLED}, n AS ({_NOW}) SELECT 'duplicates' AS stage, coalesce(sum(c - 1), 0)::BIGINT AS n FROM (SELECT count(*) AS c FROM f GROUP BY entity, key, value) UNION ALL SELECT 'stale', count(*) FROM f WHERE vt IS NULL AND date_diff('day', try_cast(substr(vf, 1, 10) AS DATE), DATE '{DAY}') >= 365"
        f" UNION ALL SELECT 'orphans', count(*) FROM ({_ORPHANS}) UNION ALL SELECT 'observations', count(DISTINCT entity) FROM n WHERE value IS NOT NULL UNION ALL SELECT 'contradictions', count(*) FROM se"
    ),
    "health_grade": (
        f"WITH {DOCS}, {FV}, b AS (SELECT 'source_attribution' AS assertion, count(*) AS n_bad FROM docs WHERE dir IN ('entities', 'live-notes') AND NOT contains(content, '[Source:') UNION ALL SELECT 'no_stale_inbox', count(*) FROM docs WHERE dir = 'inbox' AND date_diff('day', mtime::DATE, DATE '{AS_OF}') > 7"
        " UNION ALL SELECT 'no_orphan_facts', count(*) FROM f WHERE entity NOT IN (SELECT id FROM nodes WHERE id IS NOT NULL) UNION ALL SELECT 'no_duplicate_facts', count(*) FROM (SELECT 1 FROM f GROUP BY entity, key, value HAVING count(*) > 1) UNION ALL SELECT 'no_conflicts', count(*) FROM (SELECT 1 FROM f WHERE value IS NOT NULL GROUP BY entity, key HAVING count(DISTINCT value) > 1))"
        ", g AS (SELECT *, n_bad = 0 AS passed, avg((n_bad = 0)::INT) OVER () AS rate FROM b) SELECT assertion, n_bad, passed, CASE WHEN rate >= 0.8 THEN 'A' WHEN rate >= 0.6 THEN 'B' WHEN rate >= 0.4 THEN 'C' ELSE 'D' END AS grade FROM g"
    ),
    "graph_similar_all": f"WITH {_LABEL}, q AS (SELECT node_no, id FROM nodes WHERE node_no % 20 = 0 AND id IS NOT NULL), s AS (SELECT q.node_no AS query_no, b.id, sum(a.w * b.w) AS dot, any_value(ma.norm) AS na FROM q JOIN v a ON q.id = a.id JOIN m ma ON ma.id = q.id JOIN v b ON a.g = b.g AND b.id <> q.id GROUP BY 1, 2), r AS (SELECT query_no, s.id, floor(dot / (na * norm) * 10000 + 0.5) / 10000.0 AS score FROM s JOIN m ON s.id = m.id) SELECT * FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_no ORDER BY score DESC, id) <= 10",
    "search_rrf": f"WITH {DOCS}, {_NOTES}, u AS ({' UNION ALL '.join(f'SELECT doc_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS x FROM l{i}' for i in range(len(_VARIANTS)))}) SELECT doc_id, sum(x) AS rrf_score, count(*) AS n_lists FROM u GROUP BY doc_id ORDER BY rrf_score DESC, doc_id LIMIT 20",
}
