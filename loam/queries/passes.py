"""Queries in several passes, over snapshots, conversations and streams, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions.text import subqueries, tokens_of
from loam.operators import facts, lexical, multipass, reports
from loam.queries.memory import FV
from loam.queries.retrieval import AS_OF, DOCS, Q, WORDS, composite_sql, top_sql
from loam.sources.tables import spread, table

SNAPS = {"2024-01-01": "dir <> 'tasks'", "2025-01-01": "dir <> 'debug'", "2026-01-01": "dir <> 'inbox'"}
WHO = "shared-inbox-relay"


def _d(s, d):
    return lexical.corpus(spread(table(s, d, "documents")))


def _three(s, d):
    edges = table(s, d, "edges", "from_id", "to_id").select(F.lower(F.trim("from_id")).alias("from_id"), F.lower(F.trim("to_id")).alias("to_id")).where("from_id != '' and to_id != ''")
    return multipass.three_pass(_d(s, d), edges, facts.facts_view(table(s, d, "facts")), Q, AS_OF)


def _hybrid(s, d):
    vectors = table(s, d, "embeddings")
    return multipass.hybrid(lexical.search(_d(s, d), Q, AS_OF, 30), multipass.nearest(vectors, reports.first_vector(vectors), 30)).select("doc_id", "n_lists", "rrf_score", "confidence")


def _travel(s, d):
    docs = _d(s, d).select("path", "content", "dir")
    snaps = None
    for taken, rule in SNAPS.items():
        part = docs.where(rule).select(F.lit(taken).alias("taken"), "path", "content")
        snaps = part if snaps is None else snaps.unionByName(part)
    return multipass.time_travel(snaps, "2025-06-01", "storage quota")


def _stream_counts(s, d):
    """Pattern counts of the whole event table as one stream run to its end."""
    import uuid

    from loam.session import checkpoint_folder
    from loam.streaming.streams import OUT, pattern_counts, write_updates

    events = table(s, d, "events")
    where = f"{checkpoint_folder(s)}/stream-{uuid.uuid4().hex}"
    stream = s.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    query = write_updates(pattern_counts(stream), f"{where}/rows", f"{where}/state")
    query.awaitTermination()
    return s.read.schema(OUT).parquet(f"{where}/rows").groupBy("event_type").agg(F.max("n").alias("n"))


COMPOUND = "what is the budget of the garden survey?"
PARTS = subqueries(COMPOUND)


def _compound(s, d):
    return multipass.compound(_d(s, d), COMPOUND, AS_OF)


QUERIES = {
    "compound_search": _compound,
    "three_pass_search": _three,
    "hybrid_search": _hybrid,
    "time_travel": _travel,
    "experience_recall": lambda s, d: multipass.recall(_d(s, d), "storage quota review meeting"),
    "prompt_evidence": lambda s, d: multipass.evidence(_d(s, d), "storage quota review", AS_OF),
    "session_blocks": lambda s, d: multipass.session_blocks(multipass.turns(_d(s, d))),
    "related_incidents": lambda s, d: multipass.related(reports.incidents(table(s, d, "events"))),
    "persona_context": lambda s, d: multipass.persona_context(facts.facts_view(table(s, d, "facts")), WHO, "2024-06-30"),
    "stream_pattern_counts": _stream_counts,
}

_W = lambda q: list(dict.fromkeys(tokens_of(q)))
_rank = lambda src, k="entity": f"SELECT {k}, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, {k})) AS x FROM {src}"
_NOW = "SELECT key, value FROM o WHERE (vf IS NULL OR vf <= '2024-06-30') AND (vt IS NULL OR vt >= '2024-06-30') QUALIFY row_number() OVER (PARTITION BY key ORDER BY recorded DESC, line_no, value DESC) = 1"
_PART = ", ".join(f"{composite_sql(q, f'c{i}')}, h{i} AS ({top_sql(f'c{i}', 20)})" for i, q in enumerate(PARTS))
_HELD = " + ".join(f"contains(lower(content), '{w}')::INT" for w in _W(COMPOUND))
_WHOLE = " OR ".join(f"contains(lower(content), '{p.lower()}')" for p in PARTS)
SQL: dict[str, str] = {
    "compound_search": (
        f"WITH {DOCS}, {_PART}, f AS (SELECT doc_id, max(score) AS score FROM ({' UNION ALL '.join(f'SELECT * FROM h{i}' for i in range(len(PARTS)))}) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20)"
        ", t AS (SELECT DISTINCT trim(string_split(unnest(regexp_extract_all(content, '\\[\\[([^\\[\\]\\n]+)\\]\\]', 1)), '|')[1]) AS entity FROM docs WHERE doc_id IN (SELECT doc_id FROM f))"
        f", p AS (SELECT doc_id, least(1::DOUBLE, 0.3::DOUBLE * ({_HELD}) + (CASE WHEN {_WHOLE} THEN 0.5 ELSE 0 END)::DOUBLE) AS score FROM docs WHERE entity IN (SELECT entity FROM t) AND doc_id NOT IN (SELECT doc_id FROM f))"
        " SELECT * FROM (SELECT * FROM f UNION ALL SELECT * FROM p WHERE score > 0) ORDER BY score DESC, doc_id LIMIT 40"
    ),
    "three_pass_search": (
        f"WITH {DOCS}, {composite_sql(Q, 'c')}, h AS ({top_sql('c', 40)}), {FV}, e AS (SELECT * FROM (SELECT lower(trim(from_id)) AS from_id, lower(trim(to_id)) AS to_id FROM edges) WHERE from_id <> '' AND to_id <> '')"
        ", a AS (SELECT entity, max(score) AS score FROM h JOIN docs ON h.doc_id = docs.doc_id WHERE entity IS NOT NULL GROUP BY entity), s AS (SELECT entity AS seed FROM a ORDER BY score DESC, entity LIMIT 5)"
        f", b AS (SELECT to_id AS entity, 0.4::DOUBLE + 0.6::DOUBLE * (len(list_intersect(list_distinct({WORDS.format("replace(to_id, chr(45), chr(32))")}), {_W(Q)})) / {len(_W(Q))}.0::DOUBLE) + least(0.1::DOUBLE, count(*) / 100.0::DOUBLE) AS score FROM e JOIN s ON from_id = seed GROUP BY to_id ORDER BY score DESC, entity LIMIT 60)"
        f", g AS (SELECT value, max(vf) AS vf FROM f JOIN s ON entity = seed WHERE vf IS NOT NULL GROUP BY value), t AS (SELECT lower(value) AS entity, max(1.0::DOUBLE / (1.0::DOUBLE + greatest(date_diff('day', try_cast(substr(vf, 1, 10) AS DATE), DATE '{AS_OF}'), 0) / 365.0::DOUBLE)) AS score FROM g WHERE value IS NOT NULL GROUP BY 1 ORDER BY score DESC, entity LIMIT 60)"
        f" SELECT entity, sum(x) AS rrf_score, count(*) AS n_lists FROM ({_rank('a')} UNION ALL {_rank('b')} UNION ALL {_rank('t')}) GROUP BY entity ORDER BY rrf_score DESC, entity LIMIT 20"
    ),
    "hybrid_search": f"WITH {DOCS}, {composite_sql(Q, 'c')}, h AS ({top_sql('c', 30)}), q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1), n AS (SELECT vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) AS score FROM embeddings, q ORDER BY score DESC, doc_id LIMIT 30), u AS (SELECT doc_id, sum(x * 0.5::DOUBLE) AS rrf_score, count(*) AS n_lists FROM ({_rank('h', 'doc_id')} UNION ALL {_rank('n', 'doc_id')}) GROUP BY doc_id) SELECT *, least(1::DOUBLE, rrf_score * 61) AS confidence FROM u",
    "time_travel": f"WITH {DOCS}, d AS (SELECT path, lower(content) AS t FROM docs WHERE dir <> 'debug'), s AS (SELECT path, CASE WHEN contains(t, 'storage quota') THEN 1.0 ELSE 0.5 * ((contains(t, 'storage')::INT + contains(t, 'quota')::INT) / 2.0) END::DOUBLE AS score FROM d) SELECT * FROM s WHERE score > 0",
    "experience_recall": f"WITH {DOCS}, w AS (SELECT doc_id, mtime, list_distinct({WORDS.format('content')}) AS w FROM docs), s AS (SELECT doc_id, mtime, len(list_intersect(w, {_W('storage quota review meeting')})) / len(list_distinct(list_concat(w, {_W('storage quota review meeting')})))::DOUBLE AS score FROM w) SELECT doc_id, score FROM s WHERE score >= 0.01 ORDER BY score DESC, mtime DESC, doc_id LIMIT 20",
    "prompt_evidence": f"WITH {DOCS}, w AS (SELECT doc_id, len(list_intersect(list_distinct({WORDS.format('content')}), {_W('storage quota review')})) / 3.0::DOUBLE AS share, greatest(0.1::DOUBLE, 1 - greatest(date_diff('day', mtime::DATE, DATE '{AS_OF}'), 0) / 900.0::DOUBLE) AS fresh FROM docs) SELECT doc_id, share * fresh AS score FROM w WHERE share >= 0.3",
    "session_blocks": f"WITH {DOCS}, p AS (SELECT doc_id, regexp_extract_all(content, '\\[(USER|ASSISTANT|SYSTEM)\\] *([^\\n\\r]*)', 1) AS r, regexp_extract_all(content, '\\[(USER|ASSISTANT|SYSTEM)\\] *([^\\n\\r]*)', 2) AS t FROM docs), u AS (SELECT doc_id, unnest(r) AS role, unnest(t) AS text, generate_subscripts(r, 1) AS pos FROM p), b AS (SELECT *, CASE WHEN role = 'USER' AND regexp_matches(lower(text), '^(?:hi|hello|hey|good morning|can you remind)') AND max((role = 'ASSISTANT')::INT) OVER w = 1 THEN 1 ELSE 0 END AS begins FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)), n AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS no FROM b), m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, no ORDER BY pos) AS rn FROM n) SELECT doc_id, no || '.' || ((rn - 1) // 30) AS session, count(*) AS n_turns FROM m GROUP BY ALL",
    "related_incidents": "WITH i AS (SELECT event_id, user_id, ts, CASE WHEN value >= 75 THEN 'critical' WHEN value >= 50 THEN 'high' WHEN value >= 25 THEN 'medium' ELSE 'low' END AS severity FROM events WHERE event_type = 'error'), s AS (SELECT a.event_id AS incident, b.event_id AS other, (CASE WHEN a.severity = b.severity THEN 1.0 ELSE 0.5 END)::DOUBLE - 0.01::DOUBLE * abs(date_diff('day', b.ts, a.ts)) AS score FROM i a JOIN i b ON a.user_id = b.user_id AND a.event_id <> b.event_id WHERE a.event_id % 20 = 0) SELECT *, row_number() OVER (PARTITION BY incident ORDER BY score DESC, other) AS pos FROM s QUALIFY pos <= 3",
    "persona_context": f"WITH {FV}, o AS (SELECT * FROM f WHERE entity = '{WHO}' AND value IS NOT NULL) SELECT 'current' AS layout, key || ': ' || value AS line FROM ({_NOW}) UNION ALL SELECT 'evolution', key || ' ' || vf || ' ' || max(value) FROM o WHERE vf IS NOT NULL GROUP BY key, vf UNION ALL SELECT 'by_key', key || '=' || count(DISTINCT value) FROM o GROUP BY key",
    "stream_pattern_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
}
