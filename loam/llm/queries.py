"""Queries of the optional subpackage over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from loam.llm.bpe import encode_documents
from loam.llm.components import alias_groups
from loam.llm.dress import copy_histogram, dressed_copies
from loam.llm.mixing import mix_sources, share_report, sized_documents
from loam.llm.names import linked_names, name_entities
from loam.llm.residue import fit, residue_documents, residue_scores
from loam.session import cut
from loam.sources.tables import spread, table


def p3_found(spark, d):
    return dressed_copies(table(spark, d, "nodes", "node_no", "label"), table(spark, d, "edges", "id", "from_id", "relation", "to_id", "graph_type"))


def p3_histogram(spark, d):
    return copy_histogram(p3_found(spark, d))


def p4_found(spark, d):
    return linked_names(table(spark, d, "nodes", "id", "node_type", "label"), table(spark, d, "aliases", "alias_no", "alias", "canonical"))


def p4_entities(spark, d):
    """Members of each person or organization: one row per node id or alias row."""
    return name_entities(table(spark, d, "nodes", "id", "node_type", "label"), table(spark, d, "aliases", "alias_no", "alias", "canonical"))


def p7_found(spark, d):
    return alias_groups(table(spark, d, "aliases", "alias", "canonical"))


def p8_ids(spark, d):
    return encode_documents(spread(table(spark, d, "documents", "doc_id", "text")))


def _sized(spark, d):
    return sized_documents(spread(table(spark, d, "documents", "doc_id", "source", "text")))


def p9_selection(spark, d):
    return mix_sources(_sized(spark, d), table(spark, d, "mix_targets"))


def p9_shares(spark, d):
    sized, targets = cut(_sized(spark, d)), table(spark, d, "mix_targets")
    return share_report(mix_sources(sized, targets), targets, sized)


def p10_found(spark, d):
    return residue_documents(spread(table(spark, d, "documents", "doc_id", "text")))


def p10_scores(spark, d):
    documents = spread(table(spark, d, "documents", "doc_id", "text"))
    return residue_scores(documents, fit(documents))


QUERIES = {f.__name__: f for f in (p3_found, p3_histogram, p4_found, p4_entities, p7_found, p8_ids, p9_selection, p9_shares, p10_found, p10_scores)}
_FOLD = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_COPIES = (
    f"WITH n AS (SELECT {_FOLD.format('label')} AS k, node_no FROM nodes WHERE label IS NOT NULL), e AS (SELECT coalesce(graph_type, 'entity') AS g, {_FOLD.format('from_id')} AS a, coalesce({_FOLD.format('relation')}, '') AS r, {_FOLD.format('to_id')} AS b, id"
    " FROM edges WHERE coalesce(graph_type, 'entity') <> 'temporal' AND regexp_matches(from_id, '[^\\s\\p{Z}]') AND regexp_matches(to_id, '[^\\s\\p{Z}]')),"
    " s AS (SELECT g, r, id, CASE WHEN r IN ('knows', 'partnerof', 'collaborateswith', 'siblingof', 'relatedto', 'similarto') THEN least(a, b) ELSE a END AS a, CASE WHEN r IN ('knows', 'partnerof', 'collaborateswith', 'siblingof', 'relatedto', 'similarto') THEN greatest(a, b) ELSE b END AS b FROM e),"
    " c AS (SELECT 'nodes' AS source_table, min(node_no) AS first_key, count(*) AS copies FROM n GROUP BY k HAVING copies > 1 UNION ALL SELECT 'edges', min(id), count(*) AS copies FROM s GROUP BY g, r, a, b HAVING copies > 1)"
)
_CLEAN = "lower(regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))"
SQL: dict[str, str] = {
    "p3_found": f"{_COPIES} SELECT * FROM c",
    "p3_histogram": f"{_COPIES} SELECT source_table, copies, count(*) AS n_groups, sum(copies - 1) AS n_surplus FROM c GROUP BY ALL",
    "p7_found": (
        f"WITH RECURSIVE p AS (SELECT {_CLEAN.format('alias')} AS a, {_CLEAN.format('canonical')} AS b FROM aliases), l AS (SELECT a, b FROM p WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM p WHERE a IS NOT NULL AND b IS NOT NULL),"
        " n AS (SELECT a AS name FROM p WHERE a IS NOT NULL UNION SELECT b FROM p WHERE b IS NOT NULL), r AS (SELECT name, name AS other FROM n UNION SELECT r.name, l.b FROM r JOIN l ON r.other = l.a) SELECT name, min(other) AS group_name FROM r GROUP BY name"
    ),
}
