"""Queries over facts, graph and links, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.operators import facts, graph, lexical
from loam.queries.retrieval import DOCS
from loam.sources.tables import spread, table

DAY = "2023-06-30"
SEED = "shared-inbox-relay"
EVENT = "shared-inbox-relay"


def _f(s, d):
    return facts.facts_view(table(s, d, "facts"))


def _e(s, d):
    return graph.edges_view(table(s, d, "edges"))


def _n(s, d):
    return table(s, d, "nodes")


def _d(s, d):
    return lexical.corpus(spread(table(s, d, "documents")))


def _role_of_documents(s, d):
    asks = table(s, d, "documents", "doc_id", "entity", "mtime").where("entity is not null").select("entity", "doc_id", F.date_format("mtime", "yyyy-MM-dd").alias("day"))
    return facts.as_of_join(asks, _f(s, d).where("key = 'role' and value is not null"), ["entity"], "day", "vf", "doc_id", "value").select("doc_id", "value")


def _link_graph(s, d):
    """Around the target most linked to (ties: the smallest)."""
    top = graph.backlinks(_d(s, d)).orderBy(F.desc("n_docs"), "target").first()
    return graph.link_neighbours(_d(s, d), top["target"] if top else "")


def _pages(s, d):
    return table(s, d, "documents", "source", "entity").where("source in ('entities', 'live-notes') and entity is not null").select(F.col("entity").alias("slug"))


def _causal(direction):
    return lambda s, d: graph.reachable(graph.causal_edges(_e(s, d), direction), EVENT, 5)


QUERIES = {
    "fact_as_of": lambda s, d: facts.fact_at(_f(s, d), DAY),
    "fact_asof_join": _role_of_documents,
    "fact_history": lambda s, d: facts.history(_f(s, d), "shared-inbox-relay"),
    "fact_close_stale": lambda s, d: facts.close_stale(_f(s, d)),
    "fact_invalidate": lambda s, d: facts.invalidate(_f(s, d), "role", "2025-01-01"),
    "fact_keys": lambda s, d: facts.keys_of(_f(s, d)),
    "fact_dedup": lambda s, d: facts.deduplicated(_f(s, d)),
    "stale_facts": lambda s, d: facts.stale(_f(s, d), "2025-12-31"),
    "observations": lambda s, d: facts.observations(_f(s, d), DAY),
    "fact_contradictions": lambda s, d: facts.contradictions(_f(s, d)),
    "pref_conflicts": lambda s, d: facts.conflicting_keys(_f(s, d)),
    "pref_context": lambda s, d: facts.preference_context(_f(s, d), DAY, ["diet", "tooling"]),
    "fact_chain": lambda s, d: facts.chain(_f(s, d), "2023-01-01", "2023-12-31"),
    "pref_edges": lambda s, d: facts.preference_edges(_f(s, d), ["diet", "tooling"]),
    "neighbors_2hop": lambda s, d: graph.walk(_e(s, d), SEED, 2),
    "causal_backward": _causal("backward"),
    "causal_forward": _causal("forward"),
    "graph_stats": lambda s, d: graph.stats(_n(s, d), _e(s, d)),
    "graph_hubs": lambda s, d: graph.hub_edges(_e(s, d)),
    "node_upsert": lambda s, d: graph.newest_nodes(_n(s, d)),
    "edge_upsert": lambda s, d: graph.distinct_edges(_e(s, d)),
    "graph_similar": lambda s, d: graph.similar(_n(s, d), "kofi pabranrusk"),
    "graph_orphans": lambda s, d: graph.orphan_nodes(_n(s, d), _e(s, d), table(s, d, "documents")),
    "link_table": lambda s, d: graph.link_table(_d(s, d)),
    "link_backlinks": lambda s, d: graph.backlinks(_d(s, d)),
    "link_graph": _link_graph,
    "link_orphans": lambda s, d: graph.broken_links(_d(s, d), _pages(s, d)),
    "suggest_links": lambda s, d: graph.suggested_links(_d(s, d), _n(s, d)),
    "cleanup_orphans": lambda s, d: graph.unreferenced(_d(s, d), F.col("entity")),
    "alias_resolve": lambda s, d: graph.resolve_aliases(table(s, d, "documents", "entity").where("entity is not null").select(F.lower(F.regexp_replace("entity", "-", " ")).alias("name")).distinct(), table(s, d, "aliases")),
}

_B = "CASE WHEN lower(trim({0})) IN ('', 'now', 'none', 'null') THEN NULL ELSE trim({0}) END"
FV = f"f AS (SELECT entity, key, value, {_B.format('valid_from')} AS vf, {_B.format('valid_to')} AS vt, coalesce({_B.format('recorded_at')}, '') AS recorded, coalesce(line_no, 0) AS line_no FROM facts WHERE entity IS NOT NULL AND key IS NOT NULL)"
EV = "e AS (SELECT * FROM (SELECT id, lower(trim(from_id)) AS from_id, lower(trim(relation)) AS relation, lower(trim(to_id)) AS to_id, coalesce(graph_type, 'entity') AS graph_type FROM edges) WHERE from_id <> '' AND to_id <> '')"
_NOW = f"SELECT entity, key, value FROM f WHERE (vf IS NULL OR vf <= '{DAY}') AND (vt IS NULL OR vt >= '{DAY}') QUALIFY row_number() OVER (PARTITION BY entity, key ORDER BY recorded DESC, line_no, coalesce(value, '') DESC, value IS NULL) = 1"
LINKS = f"{DOCS}, l AS (SELECT DISTINCT doc_id, target FROM (SELECT doc_id, trim(string_split(unnest(regexp_extract_all(content, '\\[\\[([^\\[\\]\\n]+)\\]\\]', 1)), '|')[1]) AS target FROM docs) WHERE target <> '')"
MENTIONS = (
    "b AS (SELECT doc_id, regexp_replace(content, '\\[\\[[^\\[\\]\\n]*\\]\\]', ' ', 'g') AS bare FROM docs), m AS (SELECT DISTINCT doc_id, unnest(list_concat("
    f"regexp_extract_all(lower(bare), '{graph.SLUG}'), list_transform(regexp_extract_all(bare, '{graph.NAME}'), lambda x: lower(replace(x, ' ', '-'))))) AS slug FROM b)"
)
_BACK = "c AS (SELECT from_id, to_id FROM e WHERE graph_type = 'causal' AND relation = 'caused_by')"
_FORE = "c AS (SELECT from_id, to_id FROM e WHERE graph_type = 'causal' AND relation = 'resulted_in' UNION SELECT to_id, from_id FROM e WHERE graph_type = 'causal' AND relation = 'caused_by')"
_REACH = f"r AS (SELECT to_id AS node, 1 AS depth FROM c WHERE from_id = '{EVENT}' UNION SELECT c.to_id, r.depth + 1 FROM r JOIN c ON c.from_id = r.node WHERE r.depth < 5) SELECT node, min(depth) AS depth FROM r WHERE node <> '{EVENT}' GROUP BY node"
SQL: dict[str, str] = {
    "fact_as_of": f"WITH {FV} {_NOW}",
    "fact_asof_join": f"WITH {FV}, a AS (SELECT doc_id, entity, strftime(mtime, '%Y-%m-%d') AS day FROM documents WHERE entity IS NOT NULL) SELECT doc_id, (SELECT max_by(value, (vf, value)) FROM f WHERE f.entity = a.entity AND key = 'role' AND value IS NOT NULL AND vf <= day) AS value FROM a",
    "fact_history": f"WITH {FV} SELECT key, value, vf, vt, recorded, line_no FROM f WHERE entity = 'shared-inbox-relay'",
    "fact_close_stale": f"WITH {FV}, s AS (SELECT DISTINCT entity, key, vf FROM f WHERE vf IS NOT NULL), n AS (SELECT *, lead(vf) OVER (PARTITION BY entity, key ORDER BY vf) AS closed_to FROM s) SELECT f.entity, f.key, value, f.vf, line_no, closed_to FROM f JOIN n ON f.entity = n.entity AND f.key = n.key AND f.vf = n.vf WHERE vt IS NULL AND closed_to IS NOT NULL",
    "fact_invalidate": f"WITH {FV} SELECT entity, key, value, vf, CASE WHEN key = 'role' AND vt IS NULL THEN '2025-01-01' ELSE vt END AS vt, line_no, key = 'role' AND vt IS NULL AS closed FROM f",
    "fact_keys": f"WITH {FV} SELECT entity, string_agg(DISTINCT key, ',' ORDER BY key) AS keys, count(DISTINCT key) AS n_keys FROM f GROUP BY entity",
    "fact_dedup": f"WITH {FV} SELECT entity, key, value, vf, vt, line_no, count(*) OVER (PARTITION BY entity, key, value) AS n_copies FROM f QUALIFY row_number() OVER (PARTITION BY entity, key, value ORDER BY vt IS NULL DESC, recorded DESC, line_no, coalesce(vf, '') DESC, vf NULLS FIRST, vt DESC NULLS LAST) = 1",
    "stale_facts": f"WITH {FV} SELECT entity, key, value, vf, line_no, date_diff('day', try_cast(substr(vf, 1, 10) AS DATE), DATE '2025-12-31') AS age FROM f WHERE vt IS NULL AND age >= 365",
    "observations": f"WITH {FV}, n AS ({_NOW}) SELECT entity, list_aggregate(list_slice(list_sort(list(key || '=' || value)), 1, 5), 'string_agg', '; ') AS observation FROM n WHERE value IS NOT NULL GROUP BY entity",
    "fact_contradictions": f"WITH {FV}, k AS (SELECT DISTINCT entity, key, value, vf, vt, line_no, coalesce(vf, '0000') AS a, coalesce(vt, '9999') AS b FROM f WHERE value IS NOT NULL), r AS (SELECT * FROM k WHERE a <= b) SELECT x.entity, x.key, x.value, x.vf, x.vt, x.line_no, count(*) AS n_conflicts FROM r x JOIN r y ON x.entity = y.entity AND x.key = y.key AND x.value <> y.value AND x.a <= y.b AND y.a <= x.b GROUP BY ALL",
    "pref_conflicts": f"WITH {FV} SELECT entity, key, count(DISTINCT value) AS n_values, max_by(value, (coalesce(vf, ''), recorded, -line_no, value)) AS current FROM f WHERE value IS NOT NULL GROUP BY entity, key HAVING n_values > 1",
    "pref_context": f"WITH {FV}, n AS ({_NOW}), w AS (SELECT *, (CASE WHEN key IN ('diet', 'tooling') THEN 1.0 ELSE 0.3 END)::DOUBLE AS weight FROM n WHERE value IS NOT NULL) SELECT *, row_number() OVER (PARTITION BY entity ORDER BY weight DESC, key) AS pos FROM w QUALIFY pos <= 3",
    "fact_chain": f"WITH {FV}, r AS (SELECT entity, key, value, vf, line_no, date_diff('day', try_cast(substr(vf, 1, 10) AS DATE), DATE '2023-12-31') AS age FROM f WHERE vf BETWEEN '2023-01-01' AND '2023-12-31') SELECT entity, key, value, vf, line_no, 0.3::DOUBLE + 0.7::DOUBLE * (1 - age / greatest(1, max(age) OVER ())::DOUBLE) AS score FROM r WHERE age IS NOT NULL",
    "pref_edges": f"WITH {FV}, r AS (SELECT DISTINCT entity, key, value, CASE WHEN lower(trim(value)) IN ({', '.join(repr(x) for x in facts.NEGATIVE_VALUES)}) OR {' OR '.join(f'starts_with(lower(key), {chr(39)}{p}{chr(39)})' for p in facts.NEGATIVE_KEYS)} THEN 'dislikes' ELSE 'prefers' END AS verb FROM f WHERE key IN ('diet', 'tooling') AND value IS NOT NULL), k AS (SELECT * FROM r WHERE verb = 'prefers' OR (trim(value) <> '' AND length(trim(value)) <= 60 AND len(regexp_split_to_array(trim(value), '\\s+')) <= 8 AND length(value) - length(replace(value, '.', '')) < 2 AND length(value) - length(replace(value, ',', '')) < 2)) SELECT entity AS from_id, verb AS relation, lower(value) AS to_id FROM k UNION SELECT lower(value), 'category', key FROM k",
    "neighbors_2hop": f"WITH {EV}, a AS (SELECT DISTINCT from_id, relation, to_id, 1 AS depth FROM e WHERE from_id = '{SEED}'), b AS (SELECT DISTINCT e.from_id, e.relation, e.to_id, 2 AS depth FROM e WHERE from_id IN (SELECT to_id FROM a) AND from_id <> '{SEED}') SELECT * FROM a UNION ALL SELECT * FROM b",
    "causal_backward": f"WITH RECURSIVE {EV}, {_BACK}, {_REACH}",
    "causal_forward": f"WITH RECURSIVE {EV}, {_FORE}, {_REACH}",
    "graph_stats": f"WITH {EV} SELECT 'node_type' AS kind, coalesce(node_type, 'unknown') AS name, count(DISTINCT id) AS n FROM nodes GROUP BY 2 UNION ALL (SELECT 'relation', relation, count(*) AS n FROM e GROUP BY 2 ORDER BY n DESC, relation LIMIT 10)",
    "graph_hubs": f"WITH {EV}, p AS (SELECT DISTINCT from_id, relation, to_id FROM e), h AS (SELECT from_id, count(*) AS degree FROM p GROUP BY 1 ORDER BY degree DESC, from_id LIMIT 20) SELECT p.from_id, relation, count(*) AS n, any_value(degree) AS degree FROM p JOIN h ON p.from_id = h.from_id GROUP BY 1, 2",
    "node_upsert": "SELECT id, node_type, label, count(*) OVER (PARTITION BY id) AS n_rows FROM nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC, node_no DESC) = 1",
    "edge_upsert": f"WITH {EV} SELECT from_id, relation, to_id, graph_type, min(id) AS id, count(*) AS n_rows FROM e GROUP BY ALL",
    "graph_orphans": f"WITH {EV} SELECT DISTINCT lower(trim(id)) AS id FROM nodes WHERE id IS NOT NULL AND lower(trim(id)) NOT IN (SELECT from_id FROM e) AND lower(trim(id)) NOT IN (SELECT to_id FROM e) AND lower(trim(id)) NOT IN (SELECT lower(trim(entity)) FROM documents WHERE entity IS NOT NULL)",
    "graph_similar": "WITH l AS (SELECT id, lower(min(label)) AS t FROM nodes WHERE id IS NOT NULL AND label IS NOT NULL GROUP BY id), c AS (SELECT count(*) AS n FROM l), x AS (SELECT id, substr(t, i, 2) AS g, count(*) AS tf FROM (SELECT id, t, unnest(generate_series(1, length(t) - 1)) AS i FROM l) GROUP BY ALL), d AS (SELECT g, ln((any_value(n) + 2) / (count(*) + 1)) + 1 AS idf FROM x, c GROUP BY g), q AS (SELECT g, count(*) AS k FROM (SELECT substr('kofi pabranrusk', unnest(generate_series(1, 14)), 2) AS g) GROUP BY g), w AS (SELECT q.g, k * coalesce(idf, 1.0) AS w FROM q LEFT JOIN d ON q.g = d.g), z AS (SELECT sqrt(sum(w * w)) AS len FROM w), s AS (SELECT id, sum(tf * idf * coalesce(w, 0)) AS dot, sqrt(sum(tf * idf * tf * idf)) AS norm FROM x JOIN d ON x.g = d.g LEFT JOIN w ON x.g = w.g GROUP BY id) SELECT id, floor(dot / (norm * len) * 10000 + 0.5) / 10000.0 AS score FROM s, z WHERE dot > 0 AND id <> 'kofi pabranrusk' ORDER BY score DESC, id LIMIT 10",
    "link_table": f"WITH {LINKS} SELECT * FROM l",
    "link_backlinks": f"WITH {LINKS} SELECT target, count(*) AS n_docs, min(doc_id) AS first_doc FROM l GROUP BY target",
    "link_graph": f"WITH {LINKS}, z AS (SELECT target AS seed FROM l GROUP BY 1 ORDER BY count(*) DESC, target LIMIT 1), a AS (SELECT DISTINCT target FROM l WHERE doc_id IN (SELECT doc_id FROM l, z WHERE target = seed) AND target <> (SELECT seed FROM z)), b AS (SELECT DISTINCT target FROM l WHERE doc_id IN (SELECT doc_id FROM l WHERE target IN (SELECT target FROM a))) SELECT target, 1 AS hop FROM a UNION ALL SELECT target, 2 FROM b WHERE target <> (SELECT seed FROM z) AND target NOT IN (SELECT target FROM a)",
    "link_orphans": f"WITH {LINKS} SELECT lower(target) AS target, count(*) AS n_docs FROM l WHERE lower(target) NOT IN (SELECT lower(entity) FROM documents WHERE source IN ('entities', 'live-notes') AND entity IS NOT NULL) GROUP BY 1",
    "suggest_links": f"WITH {LINKS}, {MENTIONS} SELECT doc_id, slug FROM m WHERE slug IN (SELECT id FROM nodes WHERE id IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM l WHERE l.doc_id = m.doc_id AND l.target = m.slug)",
    "cleanup_orphans": f"WITH {LINKS}, {MENTIONS} SELECT DISTINCT entity AS slug FROM docs WHERE dir = 'live-notes' AND entity IS NOT NULL AND entity NOT IN (SELECT target FROM l) AND entity NOT IN (SELECT slug FROM m)",
    "alias_resolve": "WITH n AS (SELECT DISTINCT lower(replace(entity, '-', ' ')) AS name FROM documents WHERE entity IS NOT NULL), k AS (SELECT lower(trim(alias)) AS name, min(lower(trim(canonical))) AS c FROM aliases WHERE canonical IS NOT NULL GROUP BY 1) SELECT n.name, coalesce(c, n.name) AS canonical FROM n LEFT JOIN k ON n.name = k.name",
}
