"""Queries over stores and entities, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions.text import chunk_size, chunks, tokens_of
from loam.operators import facts, graph, lexical, lifecycle, reports, stores
from loam.queries.memory import EV, FV
from loam.queries.reports import _DECAYED, _HY, _LINES, _WS
from loam.queries.retrieval import DOCS, WORDS, _hits_sql, hits
from loam.sources.tables import spread, table

WHO = "shared-inbox-relay"
GOAL = "choir rehearsal in Venmark"


def _d(s, d):
    return lexical.corpus(spread(table(s, d, "documents")))


def _f(s, d):
    return facts.facts_view(table(s, d, "facts"))


def _rca(s, d):
    docs = _d(s, d)
    return stores.root_causes(docs, reports.debug_hypotheses(docs))


def _chunk_search(s, d):
    docs = _d(s, d)
    rows = docs.select("doc_id", F.explode(chunks(F.col("content"), chunk_size(F.length("content")), 50)).alias("chunk"))
    return stores.chunk_search(rows, "storage quota review", 30)


QUERIES = {
    "detect_entities": lambda s, d: stores.detected(_d(s, d)),
    "state_changes": lambda s, d: stores.state_changes(_f(s, d)),
    "resolve_newest": lambda s, d: stores.resolved(_f(s, d)),
    "resolve_confidence": lambda s, d: stores.resolved(_f(s, d), "confidence"),
    "flush_sections": lambda s, d: stores.sections(_d(s, d)),
    "root_causes": _rca,
    "runbook_upsert": lambda s, d: stores.runbooks(table(s, d, "events")),
    "task_cleanup": lambda s, d: stores.finished_tasks(table(s, d, "events"), "2024-02-10", 5),
    "prompt_summary": lambda s, d: stores.prompt_summary(table(s, d, "events")),
    "entity_brief": lambda s, d: stores.brief(_d(s, d), _f(s, d), graph.edges_view(table(s, d, "edges")), WHO),
    "chunk_search": _chunk_search,
    "goal_rerank": lambda s, d: stores.goal_rerank(hits(s, d), GOAL),
    "memory_types": lambda s, d: _d(s, d).groupBy(lifecycle.memory_type(F.col("content")).alias("memory_type")).agg(F.count(F.lit(1)).alias("n")),
}

_ENT = " UNION ALL ".join(f"SELECT DISTINCT doc_id, '{k}' AS kind, unnest(regexp_extract_all(content, '{p}')) AS name FROM docs" for k, p in {"person": stores.PERSON, **stores.ENTITY_PATTERNS}.items())
_GOAL = list(dict.fromkeys(tokens_of(GOAL)))
_N = {k: f"len(regexp_extract_all(content, '[Cc]onfidence: {k}'))" for k in ("verified", "experimental", "hypothesis")}
_TYPE, _RATE = _DECAYED
_ROUTE = "CASE WHEN regexp_matches(lower(section), 'timeline|progress|연표|chronologie') THEN 'events' WHEN regexp_matches(lower(section), 'open points|next|할 일|questions|schritte') THEN 'tasks' WHEN regexp_matches(lower(section), 'why|how|outcome|결과|ergebnis|résultat') THEN 'decisions' ELSE 'facts' END"
_TOK = lambda x: f"list_distinct({WORDS.format(x)})"
SQL: dict[str, str] = {
    "detect_entities": f"WITH {DOCS}, x AS ({_ENT}) SELECT doc_id, kind, name FROM x WHERE kind <> 'person' OR string_split(name, ' ')[1] NOT IN ({', '.join(repr(w) for w in stores.COMMON + stores.OPENERS)})",
    "state_changes": f"WITH {FV}, s AS (SELECT entity, key, vf, max(value) AS value FROM f WHERE vf IS NOT NULL AND value IS NOT NULL GROUP BY ALL), l AS (SELECT entity, key, vf, lag(value) OVER (PARTITION BY entity, key ORDER BY vf) AS old, value AS new FROM s) SELECT * FROM l WHERE old <> new",
    "resolve_newest": f"WITH {FV} SELECT entity, key, value FROM f WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity, key ORDER BY recorded DESC, line_no, value DESC) = 1",
    "resolve_confidence": f"WITH {FV}".replace("coalesce(line_no, 0) AS line_no", "coalesce(line_no, 0) AS line_no, CASE regexp_extract(lower(value), '(verified|experimental|hypothesis)', 1) WHEN 'verified' THEN 3 WHEN 'experimental' THEN 2 WHEN 'hypothesis' THEN 1 ELSE 0 END AS trust") + " SELECT entity, key, value FROM f WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity, key ORDER BY trust DESC, recorded DESC, line_no, value DESC) = 1",
    "flush_sections": f"WITH {_LINES}, h AS (SELECT doc_id, line, coalesce(last_value(CASE WHEN starts_with(line, '## ') THEN trim(regexp_replace(line, '^## +|\\r', '', 'g')) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), '') AS section FROM ln) SELECT doc_id, section, {_ROUTE} AS route, count(*) AS n_items FROM h WHERE starts_with(line, '- ') AND length(line) > 12 GROUP BY ALL",
    "root_causes": f"WITH {_HY}, d AS (SELECT doc_id, len(list_filter(string_split(content, chr(10)), lambda x: starts_with(x, '- '))) AS n, {_TOK('content')} AS head FROM docs), j AS (SELECT hy.doc_id, pos, status, n, {_TOK('hypothesis')} AS t, head FROM hy JOIN d ON hy.doc_id = d.doc_id) SELECT doc_id, pos, (CASE status WHEN 'confirmed' THEN 0.95 WHEN 'rejected' THEN 0.05 ELSE least(0.9::DOUBLE, greatest(0.3::DOUBLE, CASE WHEN len(list_distinct(list_concat(t, head))) = 0 THEN 0 ELSE len(list_intersect(t, head)) / len(list_distinct(list_concat(t, head)))::DOUBLE END) + least(0.25::DOUBLE, 0.05::DOUBLE * n)) END)::DOUBLE AS score FROM j",
    "runbook_upsert": "WITH s AS (SELECT event_type, value, CASE WHEN value >= 75 THEN 'critical' WHEN value >= 25 THEN 'medium' ELSE 'low' END AS v FROM events) SELECT event_type AS pattern, max(value) AS confidence, count(*) AS n_uses, string_agg(DISTINCT v, ',' ORDER BY v) AS severities FROM s GROUP BY 1",
    "task_cleanup": "WITH l AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS t, max(ts) AS ts FROM events GROUP BY user_id) SELECT user_id, date_diff('day', ts::DATE, DATE '2024-02-10') AS age FROM l WHERE t = 'purchase' AND age >= 5",
    "prompt_summary": "SELECT user_id, count(*) AS n, count(*) FILTER (value >= 50) AS n_pass, max(value) AS best, n_pass / n AS pass_rate, CASE WHEN n_pass / n >= 0.5 THEN 'keep' ELSE 'revise' END AS decision FROM events GROUP BY user_id",
    "entity_brief": f"WITH {DOCS}, {FV}, {EV} SELECT 'document' AS part, stem AS line FROM (SELECT stem FROM docs WHERE entity = '{WHO}' ORDER BY mtime DESC, doc_id LIMIT 10) UNION ALL SELECT DISTINCT 'key', key FROM f WHERE entity = '{WHO}' UNION ALL SELECT 'relation', relation || ' ' || n FROM (SELECT relation, count(*) AS n FROM e WHERE from_id = '{WHO}' GROUP BY 1 ORDER BY n DESC, relation LIMIT 10)",
    "chunk_search": f"WITH {DOCS}, w AS (SELECT doc_id, content, {_WS} AS w, len({_WS}) AS n FROM docs), z AS (SELECT *, CASE WHEN length(content) < 500 THEN 128 WHEN length(content) <= 2000 THEN 256 ELSE 512 END AS size FROM w), c AS (SELECT doc_id, content, w, n, size, unnest(generate_series(0, CASE WHEN n <= size THEN 0 ELSE ceil((n - size) / (size - 50)::DOUBLE)::INT END)) AS i FROM z), k AS (SELECT doc_id, lower(CASE WHEN n <= size THEN content ELSE list_aggregate(w[i * (size - 50) + 1 : i * (size - 50) + size], 'string_agg', ' ') END) AS t FROM c), s AS (SELECT doc_id, max((contains(t, 'storage')::INT + contains(t, 'quota')::INT + contains(t, 'review')::INT) / 3.0::DOUBLE) AS score FROM k GROUP BY doc_id) SELECT * FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 30",
    "memory_types": f"WITH {DOCS}, t AS (SELECT content AS text FROM docs) SELECT {_TYPE} AS memory_type, count(*) AS n FROM t GROUP BY 1",
}
