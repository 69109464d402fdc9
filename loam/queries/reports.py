"""Queries over notes, events and vectors, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import text
from loam.operators import lexical, lifecycle, reports
from loam.queries.retrieval import DOCS, WORDS
from loam.sources.tables import spread, table

AS_OF = "2026-01-01"


def _d(s, d):
    return lexical.corpus(spread(table(s, d, "documents")))


def _m(s, d):
    return lifecycle.with_meta(_d(s, d), AS_OF)


def _ev(s, d):
    return table(s, d, "events")


def _uses(s, d):
    """Uses of a document: facts recorded for its entity."""
    n = table(s, d, "facts", "entity").where("entity is not null").groupBy("entity").agg(F.count(F.lit(1)).alias("n_uses"))
    return table(s, d, "documents", "doc_id", "entity").join(n, "entity").select("doc_id", "n_uses")


def _before_after(s, d):
    """Two snapshots: without the documents of one source, and without those of another, some changed."""
    docs = _d(s, d)
    a = docs.where("dir != 'tasks'")
    b = docs.where("dir != 'debug'").withColumn("content", F.when(F.col("dir") == "decisions", F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return lifecycle.snapshot(a, "a"), lifecycle.snapshot(b, "b")


def _diff(s, d):
    return lifecycle.snapshot_diff(*_before_after(s, d))


def _snapshots(s, d):
    a, b = _before_after(s, d)
    return lifecycle.snapshot_history(a.unionByName(b), ["a", "b"])


def _vector_query(s, d):
    """Nearest to the vector of smallest id."""
    vectors = table(s, d, "embeddings")
    return reports.vector_topk(vectors, reports.first_vector(vectors)).select("vec_id", "label")


def _changed(s, d):
    docs = _d(s, d).select("doc_id", "dir", F.concat_ws(":", F.length("content"), F.date_format("mtime", "yyyyMMdd")).alias("fingerprint"))
    return reports.changed_vectors(docs.where("dir != 'inbox'").select("doc_id", "fingerprint"), docs)


QUERIES = {
    "front_matter": lambda s, d: lifecycle.meta_rows(_d(s, d)),
    "timeline_rows": lambda s, d: lifecycle.timeline(_d(s, d)),
    "fact_lines": lambda s, d: lifecycle.fact_lines(_d(s, d)),
    "decay_flags": lambda s, d: lifecycle.flagged_for_decay(_d(s, d), AS_OF),
    "auto_tier": lambda s, d: lifecycle.auto_tier(_m(s, d), _uses(s, d)),
    "tier_report": lambda s, d: lifecycle.tier_report(_m(s, d)),
    "working_set": lambda s, d: lifecycle.working_set(_m(s, d)),
    "compact": lambda s, d: lifecycle.compacted(_m(s, d), 300_000),
    "freshness": lambda s, d: lifecycle.freshness(_m(s, d)),
    "health_checks": lambda s, d: lifecycle.checks(_m(s, d)),
    "digest": lambda s, d: lifecycle.digest(_m(s, d), AS_OF),
    "doc_index": lambda s, d: lifecycle.index(_d(s, d)),
    "snapshot_diff": _diff,
    "snapshot_history": _snapshots,
    "statements": lambda s, d: reports.statements(_d(s, d)),
    "keywords_topn": lambda s, d: reports.keywords(_d(s, d)),
    "chunk_docs": lambda s, d: reports.chunked(_d(s, d)),
    "extract_values": lambda s, d: reports.extracted(_d(s, d)),
    "open_loops": lambda s, d: reports.open_loops(_d(s, d)),
    "distill_decisions": lambda s, d: reports.decisions(_d(s, d), _ev(s, d)),
    "debug_hypotheses": lambda s, d: reports.debug_hypotheses(_d(s, d)),
    "debug_status": lambda s, d: reports.debug_status(_d(s, d)),
    "near_lines": lambda s, d: reports.near_lines(_d(s, d)),
    "similar_lines": lambda s, d: reports.similar_lines(_d(s, d)),
    "term_overlap": lambda s, d: reports.term_overlap(_d(s, d), "storage quota review"),
    "incident_search": lambda s, d: reports.incident_search(_ev(s, d), ["high", "critical"], "2024-01-05", "2024-01-25"),
    "reasoning_patterns": lambda s, d: reports.patterns(_ev(s, d)),
    "task_latest": lambda s, d: reports.latest_state(_ev(s, d)),
    "convergence": lambda s, d: reports.convergence(_ev(s, d)),
    "eval_by_category": lambda s, d: reports.evaluation(_ev(s, d)),
    "majority_vote": lambda s, d: reports.majority(_ev(s, d)),
    "stratified_sample": lambda s, d: reports.stratified(_ev(s, d)),
    "event_days": lambda s, d: reports.daily(_ev(s, d)),
    "event_sessions": lambda s, d: reports.sessions(_ev(s, d)),
    "retro": lambda s, d: reports.retro(_ev(s, d)),
    "vector_topk": _vector_query,
    "vector_topk_all": lambda s, d: reports.vector_topk_all(table(s, d, "embeddings")),
    "vector_stats": lambda s, d: reports.vector_stats(table(s, d, "embeddings")),
    "embedding_changes": _changed,
}

_LINES = f"{DOCS}, ln AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(content, chr(10)) AS x FROM docs))"
_FRONT = "regexp_extract({0}, '(?s)\\A---\\r?\\n(.*?)\\r?\\n---', 1)"
_TIER = f"regexp_extract({_FRONT.format('content')}, '(?m)^tier: *([a-z]+)', 1)"
_META = f"{DOCS}, m AS (SELECT *, CASE WHEN {_TIER} IN ('core', 'recall', 'archival') THEN {_TIER} ELSE 'recall' END AS tier, length(content) AS size, date_diff('day', mtime::DATE, DATE '{AS_OF}') AS age FROM docs)"
_BULLET = "'^- \\*\\*(\\d{4}-\\d{2}-\\d{2})\\*\\* \\| (.*?)(?: \\[Source: ([^\\]]*)\\])?\\s*$'"
_TL = f"{_LINES}, tl AS (SELECT doc_id, line_no, " + ", ".join(f"regexp_extract(line, {_BULLET}, {i}) AS {n}" for i, n in ((1, "event_date"), (2, "text"), (3, "source"))) + " FROM ln WHERE regexp_matches(line, '^- \\*\\*\\d{4}-\\d{2}-\\d{2}\\*\\* \\| '))"
_FACT = "'^- ([^:\\n]+): (.*?) *<!-- valid:\\[([^.\\]]*)\\.\\.([^\\]\\)]*)[\\]\\)] recorded:([^ ]+) -->'"
_q = lambda s: s.replace("'", "''")
_has = lambda col, cues: " OR ".join(f"contains(lower({col}), '{_q(c)}')" for c in cues)
_hits = lambda col, cues: "(" + " + ".join(f"contains(lower({col}), '{_q(c)}')::INT" for c in cues) + ")"
_TYPE = "CASE " + " ".join(f"WHEN {_has('text', c)} THEN '{k}'" for k, c in lifecycle.MEMORY_TYPES.items()) + " ELSE 'default' END"
_RATE = "CASE memory_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in lifecycle.DECAY.items()) + " END"
_DECAYED = (_TYPE, _RATE)
_SNAP = f"{DOCS}, a AS (SELECT path, content FROM docs WHERE dir <> 'tasks'), b AS (SELECT path, CASE WHEN dir = 'decisions' THEN content || '!' ELSE content END AS content FROM docs WHERE dir <> 'debug'), j AS (SELECT coalesce(a.path, b.path) AS path, a.content AS x, b.content AS y FROM a FULL JOIN b ON a.path = b.path)"
_SENT = f"{_LINES}, st AS (SELECT doc_id, line_no, list_filter(list_transform(string_split(regexp_replace(line, '([.!?])[ \\t\\r\\f]+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p FROM ln), se AS (SELECT doc_id, line_no, unnest(p) AS sentence, generate_subscripts(p, 1) - 1 AS sentence_no FROM st)"
_SENTI = f"CASE WHEN {_hits('sentence', reports.NEGATIVE)} > {_hits('sentence', reports.POSITIVE)} THEN 'negative' WHEN {_hits('sentence', reports.POSITIVE)} > {_hits('sentence', reports.NEGATIVE)} THEN 'positive' ELSE 'neutral' END"
_CATS = ", ".join(f"{_hits('sentence', c)} AS c{i}" for i, c in enumerate(reports.CATEGORIES.values()))
_BEST = "greatest(" + ", ".join(f"c{i}" for i in range(len(reports.CATEGORIES))) + ")"
_CAT = f"CASE WHEN {_BEST} = 0 THEN 'general' " + " ".join(f"WHEN c{i} = {_BEST} THEN '{k}'" for i, k in enumerate(reports.CATEGORIES)) + " END"
_KIND = (
    "CASE WHEN regexp_matches(s, '(?:^|[^a-z])(?:started|began|now works)') THEN 'start' WHEN regexp_matches(s, 'switched|moved|replaced') THEN 'switch' WHEN regexp_matches(s, 'stopped|dropped|no longer') THEN 'stop'"
    " WHEN regexp_matches(s, '(?:^|[^a-z])(?:i like|loves?|enjoys?)(?:$|[^a-z])') THEN 'like' WHEN regexp_matches(s, 'hate|dislike|could not') THEN 'dislike' WHEN regexp_matches(s, 'prefer|favou?rite|better than') THEN 'favorite'"
    " WHEN regexp_matches(s, '(?:^|[^a-z])(?:is|are|was|lives|works|pays|owns)(?:$|[^a-z])') THEN 'fact' WHEN sentiment <> 'neutral' THEN 'sentiment' ELSE 'general' END"
)
_WS = "list_filter(regexp_split_to_array(content, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')"
_HYP = "'### H(\\d+): ([^\\n\\r]*)\\r?\\n(?:status: ([a-z]+))?'"
_HY = f"{DOCS}, h AS (SELECT doc_id, regexp_extract_all(content, {_HYP}, 1) AS a, regexp_extract_all(content, {_HYP}, 2) AS b, regexp_extract_all(content, {_HYP}, 3) AS c FROM docs), hy AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a)::INT AS no, unnest(c) AS status, unnest(b) AS hypothesis FROM h)"
_SEV = "CASE WHEN value >= 75 THEN 'critical' WHEN value >= 50 THEN 'high' WHEN value >= 25 THEN 'medium' ELSE 'low' END"


SQL: dict[str, str] = {
    "front_matter": f"WITH {DOCS}, b AS (SELECT doc_id, unnest(regexp_split_to_array({_FRONT.format('content')}, '\\r?\\n')) AS line FROM docs), p AS (SELECT DISTINCT doc_id, trim(regexp_extract(line, '^([^:]+): *(.*)$', 1)) AS key, trim(regexp_extract(line, '^([^:]+): *(.*)$', 2)) AS value FROM b WHERE regexp_matches(line, '^([^:]+): *(.*)$')) SELECT * FROM p",
    "timeline_rows": f"WITH {_TL} SELECT * FROM tl",
    "fact_lines": f"WITH {_LINES} SELECT doc_id, " + ", ".join(f"{'nullif(' if n == 'vt' else ''}regexp_extract(line, {_FACT}, {i}){', chr(0)[1:0])' if n == 'vt' else ''} AS {n}" for i, n in enumerate(("key", "value", "vf", "vt", "recorded"), 1)) + f" FROM ln WHERE regexp_matches(line, {_FACT})",
    "decay_flags": f"WITH {_TL}, t AS (SELECT doc_id, line_no, {_TYPE} AS memory_type, date_diff('day', try_cast(event_date AS DATE), DATE '{AS_OF}') AS age FROM tl) SELECT * FROM t WHERE age > floor(90::DOUBLE / greatest({_RATE}, 0.05::DOUBLE))",
    "auto_tier": f"WITH {_META}, u AS (SELECT entity, count(*) AS n FROM facts WHERE entity IS NOT NULL GROUP BY 1), s AS (SELECT doc_id, tier, floor((0.4::DOUBLE * pow(0.5::DOUBLE, greatest(age, 0) / 180.0::DOUBLE) + 0.3::DOUBLE * least(1::DOUBLE, coalesce(n, 0) / 20.0::DOUBLE) + 0.3::DOUBLE * (CASE tier WHEN 'core' THEN 1.0 WHEN 'recall' THEN 0.5 ELSE 0.1 END)::DOUBLE) * 10000 + 0.5) / 10000.0::DOUBLE AS score FROM m LEFT JOIN u ON m.entity = u.entity) SELECT doc_id, tier, CASE WHEN score >= 0.7 THEN 'core' WHEN score >= 0.25 THEN 'recall' ELSE 'archival' END AS new_tier, score FROM s",
    "tier_report": f"WITH {_META} SELECT dir, tier, count(*) AS n_docs, sum(size) AS n_chars, min(age) AS youngest, max(age) AS oldest FROM m GROUP BY dir, tier",
    "working_set": f"WITH {_META} SELECT doc_id, tier FROM m WHERE tier IN ('core', 'recall') ORDER BY tier <> 'core', mtime DESC, doc_id LIMIT 50",
    "compact": f"WITH {_META}, t AS (SELECT sum(size) AS total FROM m), c AS (SELECT doc_id, mtime, size, CASE WHEN age > 90 AND tier <> 'core' THEN 'age' WHEN age > 30 AND tier = 'recall' THEN 'budget' END AS reason FROM m WHERE dir = 'live-notes' AND tier <> 'archival'), r AS (SELECT *, sum(size) OVER (ORDER BY mtime, doc_id ROWS UNBOUNDED PRECEDING) - size AS before FROM c WHERE reason IS NOT NULL) SELECT doc_id, reason FROM r, t WHERE reason = 'age' OR total - before > 300000",
    "freshness": f"WITH {_META} SELECT dir, count(*) FILTER (age <= 7) AS week, count(*) FILTER (age > 7 AND age <= 30) AS month, count(*) FILTER (age > 30) AS older FROM m GROUP BY dir",
    "health_checks": f"WITH {_META} " + " UNION ALL ".join(f"SELECT '{k}' AS \"check\", count(*) FILTER ({c}) AS n_bad, count(*) AS n_docs FROM m" for k, c in {"no_source": "NOT contains(content, '[Source:') AND NOT contains(content, 'source:')", "thin": "size < 300", "bloated": "size > 4000", "no_confidence": "NOT contains(lower(content), 'confidence:')", "stale_inbox": "dir = 'inbox' AND age * 24 > 48"}.items()),
    "digest": f"WITH {_META}, r AS (SELECT doc_id, tier, row_number() OVER w AS pos, sum(length(stem) + 1) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM m WHERE tier = 'core' OR (tier = 'recall' AND age <= 30) WINDOW w AS (ORDER BY tier <> 'core', mtime DESC, doc_id)) SELECT doc_id, tier, pos FROM r WHERE used <= 4000",
    "doc_index": f"WITH {DOCS}, x AS (SELECT doc_id, string_split(content, chr(10)) AS l FROM docs) SELECT doc_id, substr(coalesce(list_filter(l, lambda x: length(x) > 10 AND NOT regexp_matches(x, '^(?:#|---|tier:|tags:|source:|updated:|confidence:|>|\\||```)'))[1], ''), 1, 200) AS summary, coalesce(list_aggregate(list_filter(l, lambda x: starts_with(x, '#'))[1:20], 'string_agg', '|'), '') AS headings, len(list_filter(l, lambda x: starts_with(x, '#'))) AS n_headings FROM x",
    "snapshot_diff": f"WITH {_SNAP} SELECT path, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' WHEN x <> y THEN 'modified' ELSE 'unchanged' END AS state, coalesce(length(y), 0) - coalesce(length(x), 0) AS delta FROM j",
    "snapshot_history": f"WITH {_SNAP} SELECT path, (CASE WHEN x IS NULL THEN 'absent' ELSE 'new' END) || ',' || (CASE WHEN y IS NULL THEN 'deleted' WHEN x IS NULL THEN 'new' WHEN x = y THEN 'unchanged' ELSE 'modified' END) AS states FROM j",
    "statements": f"WITH {_SENT}, k AS (SELECT doc_id, line_no, sentence_no, lower(sentence) AS s, {_SENTI} AS sentiment, {_CATS} FROM se) SELECT doc_id, line_no, sentence_no, {_KIND} AS kind, {_CAT} AS category, sentiment FROM k",
    "keywords_topn": f"WITH {DOCS}, w AS (SELECT doc_id, unnest(regexp_extract_all(lower(content), '[a-z]{{3,}}')) AS word FROM docs), c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE word NOT IN ({', '.join(repr(x) for x in dict.fromkeys(reports.STOPS))}) GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS pos FROM c QUALIFY pos <= 10",
    "chunk_docs": f"WITH {DOCS}, w AS (SELECT doc_id, content, {_WS} AS w, len({_WS}) AS n FROM docs), z AS (SELECT *, CASE WHEN length(content) < 500 THEN 128 WHEN length(content) <= 2000 THEN 256 ELSE 512 END AS size FROM w), c AS (SELECT doc_id, content, w, n, size, unnest(generate_series(0, CASE WHEN n <= size THEN 0 ELSE ceil((n - size) / (size - 50)::DOUBLE)::INT END)) AS chunk_no FROM z), k AS (SELECT doc_id, chunk_no, CASE WHEN n <= size THEN content ELSE list_aggregate(w[chunk_no * (size - 50) + 1 : chunk_no * (size - 50) + size], 'string_agg', ' ') END AS chunk FROM c) SELECT doc_id, chunk_no, length(chunk) AS n_chars, md5(chunk) AS hash FROM k",
    "extract_values": f"WITH {DOCS}, x AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, trim(unnest(regexp_extract_all(content, '{p}'))) AS value FROM docs" for k, p in reports.VALUES.items()) + ") SELECT doc_id, kind, value, count(*) AS n FROM x GROUP BY ALL",
    "open_loops": f"WITH {_LINES} SELECT ln.doc_id, line_no, strftime(mtime, '%Y-%m-%d') AS day FROM ln JOIN docs ON ln.doc_id = docs.doc_id WHERE NOT starts_with(trim(line), '#') AND ({' OR '.join(f'contains(line, {chr(39)}{c}{chr(39)})' for c in reports.PENDING)})",
    "distill_decisions": f"WITH {_LINES} SELECT 'event' AS source, event_id AS key, 0 AS line_no, 'normal' AS importance FROM events WHERE {_has('concat_ws(chr(32), event_type, props)', reports.DECIDED)} UNION ALL SELECT 'decision', doc_id, 0, 'high' FROM docs WHERE dir = 'decisions' AND ({_has('content', reports.DECIDED)}) UNION ALL SELECT 'note', ln.doc_id, line_no, 'normal' FROM ln JOIN docs ON ln.doc_id = docs.doc_id WHERE dir = 'base' AND NOT starts_with(line, '#') AND ({_has('line', reports.DECIDED)})",
    "debug_hypotheses": f"WITH {_HY} SELECT * FROM hy",
    "debug_status": f"WITH {_HY} SELECT doc_id, count(*) AS n, count(*) FILTER (status = 'confirmed') AS n_confirmed, count(*) FILTER (status = 'rejected') AS n_rejected, count(*) FILTER (status = 'testing') AS n_testing, coalesce(max(no) FILTER (status = 'testing'), 0) AS current FROM hy GROUP BY doc_id",
    "near_lines": f"WITH {_LINES}, s AS (SELECT doc_id, coalesce(list_aggregate(list_filter(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}_]+'), lambda w: NOT regexp_matches(w, '^(?:\\p{{Lu}}|[0-9])')), 'string_agg', ' '), '') AS line FROM ln WHERE starts_with(line, '- ') AND length(line) > 12) SELECT line, count(DISTINCT doc_id) AS n_docs, count(*) AS n_lines FROM s WHERE line <> '' GROUP BY line HAVING n_docs > 1",
    "term_overlap": f"WITH {DOCS}, w AS (SELECT doc_id, list_distinct({WORDS.format('content')}) AS w FROM docs) SELECT doc_id, len(list_intersect(w, {text.tokens_of('storage quota review')})) / len(list_distinct(list_concat(w, {text.tokens_of('storage quota review')})))::DOUBLE AS score FROM w WHERE len(list_intersect(w, {text.tokens_of('storage quota review')})) > 0",
    "incident_search": f"SELECT event_id, user_id, {_SEV} AS severity FROM events WHERE event_type = 'error' AND value >= 50 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' ORDER BY ts DESC, event_id LIMIT 100",
    "reasoning_patterns": "SELECT event_type, user_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY ALL HAVING n >= 2 ORDER BY n DESC, event_type, user_id LIMIT 30",
    "task_latest": "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type, count(*) AS n_events FROM events GROUP BY user_id",
    "convergence": "WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 5) SELECT event_type, max(value) - min(value) AS spread, avg(value) AS mean, spread <= 0.1::DOUBLE * abs(mean) AS settled FROM l GROUP BY event_type",
    "eval_by_category": "SELECT coalesce(event_type, '(all)') AS category, count(*) AS n, count(*) FILTER (value >= 50) AS n_pass, n_pass / n AS pass_rate FROM events GROUP BY ROLLUP (event_type)",
    "majority_vote": "WITH c AS (SELECT user_id, event_type AS winner, count(*) AS n FROM events GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, winner) = 1",
    "stratified_sample": "WITH s AS (SELECT event_type, greatest(1, floor(100::DOUBLE * count(*) / (SELECT count(*) FROM events) + 0.5)) AS quota FROM events GROUP BY 1), r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR)) AS pos FROM events) SELECT event_id, r.event_type, pos FROM r JOIN s ON r.event_type = s.event_type WHERE pos <= quota",
    "event_days": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, max(value) AS top_value FROM events GROUP BY ALL",
    "event_sessions": "WITH l AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 1800000000, true) AS new FROM events), s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l) SELECT user_id, min(epoch_us(ts)) AS start_us, count(*) AS n, min(event_id) AS first_id FROM s GROUP BY user_id, k",
    "retro": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type IN ('purchase', 'signup')) AS well, count(*) FILTER (event_type = 'error') AS bad, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1",
    "vector_topk": "WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, label FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) DESC, vec_id LIMIT 10",
    "vector_stats": "SELECT label, count(*) AS n, min(len(embedding)) AS least_dim, max(len(embedding)) AS most_dim FROM embeddings GROUP BY label",
    "embedding_changes": f"WITH {DOCS} SELECT doc_id FROM docs WHERE dir = 'inbox'",
}
SQL["fact_lines"] = SQL["fact_lines"].replace(", chr(0)[1:0])", ", '')")
