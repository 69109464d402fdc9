"""Queries that extract statements from notes, and their DuckDB SQL.

Relations, capitalised words and state fields need word boundaries of Unicode, which DuckDB's patterns don't know; they are
tested against Python's ``re`` instead.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.operators import extract, lexical
from loam.queries.retrieval import DOCS, WORDS
from loam.sources.tables import spread, table


def _d(s, d):
    return lexical.corpus(spread(table(s, d, "documents")))


QUERIES = {
    "extract_relations": lambda s, d: extract.relations(_d(s, d)),
    "stated_facts": lambda s, d: extract.stated_facts(_d(s, d)),
    "bullet_facts": lambda s, d: extract.bullet_facts(_d(s, d)),
    "key_facts": lambda s, d: extract.key_facts(_d(s, d)),
    "named_words": lambda s, d: extract.named_words(_d(s, d)),
    "personas": lambda s, d: extract.personas(_d(s, d)),
    "state_fields": lambda s, d: extract.state_fields(_d(s, d)),
    "conditions": lambda s, d: extract.conditions(_d(s, d)),
    "evidence_rows": lambda s, d: extract.evidence_rows(_d(s, d)),
    "doc_tags": lambda s, d: _d(s, d).select("doc_id", extract.tag_of(F.col("content")).alias("tags")).where("tags != ''"),
    "doc_sections": lambda s, d: _d(s, d).select("doc_id", F.md5(F.encode(extract.section_of(F.col("content"), "Timeline"), "UTF-8")).alias("hash"), F.length(extract.section_of(F.col("content"), "Timeline")).alias("n_chars")).where("n_chars > 0"),
    "doc_signatures": lambda s, d: _d(s, d).groupBy(extract.signature(F.col("content")).alias("signature")).agg(F.count(F.lit(1)).alias("n")),
    "link_context": lambda s, d: extract.link_context(_d(s, d)),
}

_FACTS = [p.replace("$)", "\\n?\\z)") for p in extract.FACTS]
_q = lambda s: s.replace("'", "''")
_PERSONA = " UNION ALL ".join(
    [f"SELECT doc_id, '{k}' AS field, trim(regexp_extract(content, '{_q(p)}', 1)) AS value FROM docs" for k, p in extract.PERSONA.items()]
    + [f"SELECT doc_id, 'profession', lower(regexp_extract(content, '(?i)\\b({'|'.join(extract.PROFESSIONS)})\\b', 1)) FROM docs"]
    + [f"SELECT doc_id, '{k}', trim(unnest(regexp_extract_all(content, '{_q(p)}', 1)[1:{n}])) FROM docs" for k, p, n in (("like", extract.LIKES, 15), ("dislike", extract.DISLIKES, 10))]
)
_REST = "regexp_extract(content, '(?s)## Timeline(.*)\\z', 1)"
SQL: dict[str, str] = {
    "stated_facts": f"WITH {DOCS}, x AS (" + " UNION ALL ".join(f"SELECT doc_id, trim(unnest(regexp_extract_all(content, '{p}', 1))) AS entity, trim(unnest(regexp_extract_all(content, '{p}', 2))) AS fact FROM docs" for p in _FACTS) + ") SELECT * FROM x WHERE length(fact) > 5 AND length(entity) > 1",
    "bullet_facts": f"WITH {DOCS}, l AS (SELECT doc_id, regexp_replace(unnest(x), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS line, generate_subscripts(x, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(content, chr(10)) AS x FROM docs)), f AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '\\[Source:.*?\\]', '', 'g'), '\\[CONFLICT\\]', '', 'g'), '^- \\*\\*\\d{{4}}-\\d{{2}}-\\d{{2}}\\*\\* \\| ', '- '), '^- ⏳ ', '- '), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '^- ', ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS fact FROM l WHERE starts_with(line, '- ') AND length(line) > 10) SELECT * FROM f WHERE fact <> ''",
    "personas": f"WITH {DOCS}, x AS ({_PERSONA}) SELECT * FROM x WHERE value <> ''",
    "conditions": f"WITH {DOCS} SELECT doc_id, 'when' AS kind, trim(unnest(regexp_extract_all(content, 'When:\\s*([^|\\]\\n]+)', 1))) AS value FROM docs UNION ALL SELECT doc_id, 'when_not', trim(unnest(regexp_extract_all(content, 'When NOT:\\s*([^|\\]\\n]+)', 1))) FROM docs",
    "doc_tags": f"WITH {DOCS}, t AS (SELECT doc_id, substr(trim(regexp_extract(content, '(?i)(?:tags?|태그):[ \\t]*([^\\n\\r]+)', 1)), 1, 50) AS tags FROM docs) SELECT * FROM t WHERE tags <> ''",
    "doc_sections": f"WITH {DOCS}, r AS (SELECT doc_id, {_REST} AS r FROM docs), u AS (SELECT doc_id, regexp_replace(CASE WHEN contains(r, chr(10) || '## ') THEN string_split(r, chr(10) || '## ')[1] WHEN contains(r, chr(10) || '---') THEN string_split(r, chr(10) || '---')[1] ELSE r END, '^\\s+|\\s+$', '', 'g') AS t FROM r) SELECT doc_id, md5(t) AS hash, length(t) AS n_chars FROM u WHERE t <> ''",
    "doc_signatures": f"WITH {DOCS}, w AS (SELECT content, list_distinct({WORDS.format('content')}) AS w FROM docs), s AS (SELECT CASE WHEN len(w) = 0 THEN 'unsignatured-' || substr(sha1(content), 1, 8) ELSE list_aggregate(list_sort(list_transform(list_sort(list_transform(w, lambda x: {{'n': -length(x), 'w': x}}))[1:4], lambda x: x.w)), 'string_agg', '-') END AS signature FROM w) SELECT signature, count(*) AS n FROM s GROUP BY 1",
    "link_context": f"WITH {DOCS}, l AS (SELECT DISTINCT doc_id, content, target FROM (SELECT doc_id, content, trim(string_split(unnest(regexp_extract_all(content, '\\[\\[([^\\[\\]\\n]+)\\]\\]', 1)), '|')[1]) AS target FROM docs) WHERE target <> ''), p AS (SELECT *, strpos(content, '[[' || target) AS i0 FROM l) SELECT doc_id, target, regexp_replace(replace(substr(content, greatest(1, i0 - 40), i0 + length(target) + 44 - greatest(1, i0 - 40)), chr(10), ' '), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS context FROM p WHERE i0 > 0",
}
