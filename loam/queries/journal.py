"""Queries over logs (tasks, channels, agents, incidents, aliases, tiers, decay) and their DuckDB SQL.

The log is made of the driver's tables: events are entries of tasks (one per user), channels (one per type) and
incidents; alias rows are entries of the alias store; documents are entries of the tier store.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.operators import journal, lexical, lifecycle, reports
from loam.sources.tables import spread, table

AS_OF = "2024-01-20 00:00:00"
WHO = "42"
DEAD = 450


def _log(s, d):
    ev = table(s, d, "events", "event_id", "ts", "user_id", "event_type", "value")
    c = F.col
    severity = F.when(c("value") >= 75, "critical").when(c("value") >= 50, "high").when(c("value") >= 25, "medium").otherwise("low")
    calls = ev.where("event_type != 'error'")
    parts = [
        journal.entries(calls, "task", c("user_id"), c("ts"), c("event_id"), {"status": c("event_type"), "value": F.floor(c("value"))}),
        journal.entries(ev.where("event_type = 'error'"), "task", c("user_id"), c("ts"), c("event_id"), {"drop": F.lit("error")}, "drop"),
        journal.entries(ev, "channel", c("event_type"), c("ts"), c("event_id"), {"member": c("user_id")}, "add"),
        journal.entries(ev.where("event_type = 'error'"), "incident", c("event_id"), c("ts"), c("event_id"), {"severity": severity, "affected": c("user_id")}),
    ]
    return reduce(DataFrame.unionByName, parts)


def _alias_log(s, d):
    rows = table(s, d, "aliases", "alias_no", "alias", "canonical").select("alias_no", F.lower(F.trim("alias")).alias("a"), F.lower(F.trim("canonical")).alias("c")).where("a != ''")
    at = F.timestamp_micros(F.col("alias_no"))
    return journal.entries(rows, "alias", F.col("a"), at, F.col("alias_no"), {"canonical": F.col("c")})


def _alias_records(s, d):
    return journal.records(_alias_log(s, d), "alias", ["canonical"])


def _tiers(s, d):
    docs = lifecycle.with_meta(lexical.corpus(spread(table(s, d, "documents"))), "2026-01-01")
    return docs.select(F.col("doc_id").cast("string").alias("id"), "tier", "mtime")


def _uses(s, d):
    return table(s, d, "events", "user_id", "ts", "value").select(F.col("user_id").cast("string").alias("id"), F.col("ts").alias("at"), (F.col("value") >= DEAD).alias("dead"))


def _weights(s, d):
    return journal.decayed(_uses(s, d), "2024-02-10", 0.5, 4)


QUERIES = {
    "task_records": lambda s, d: journal.records(_log(s, d), "task", ["status", "value"]),
    "task_as_of": lambda s, d: journal.records(_log(s, d), "task", ["status"], AS_OF),
    "task_history": lambda s, d: journal.history(_log(s, d), "task", WHO).select("id", "seq", "action", "field", "value"),
    "task_list": lambda s, d: journal.records(_log(s, d), "task", ["status", "value"]).where("status = 'purchase'").select("id", "value"),
    "task_fields": lambda s, d: journal.fields_of(_log(s, d)).where("store = 'task'").groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values")),
    "channel_members": lambda s, d: journal.members(_log(s, d), "channel", "member").select("id", "value", "n"),
    "channel_sizes": lambda s, d: journal.members(_log(s, d), "channel", "member").groupBy("id").agg(F.count(F.lit(1)).alias("n_members"), F.sum("n").alias("n_entries")),
    "channel_top": lambda s, d: journal.ranked_within(journal.members(_log(s, d), "channel", "member"), "id", [F.desc("n"), F.asc("value")], 5).select("id", "value", "n", "pos"),
    "agent_handoff": lambda s, d: journal.handed_over(_log(s, d), "task", WHO, "heir", AS_OF).select("id", "field", "value"),
    "incident_records": lambda s, d: journal.records(_log(s, d), "incident", ["severity", "affected"]),
    "incident_newest": lambda s, d: journal.newest(journal.records(_log(s, d), "incident", ["severity", "affected"]).withColumn("no", F.col("id").cast("long")), "no", 50, F.col("severity").isin("high", "critical")).select("id", "severity", "affected"),
    "alias_records": _alias_records,
    "alias_list": lambda s, d: _alias_records(s, d).groupBy("canonical").agg(F.count(F.lit(1)).alias("n_aliases"), F.min("id").alias("first_alias"), F.max("id").alias("last_alias")),
    "alias_history": lambda s, d: journal.history(_alias_log(s, d), "alias").groupBy("id").agg(F.count(F.lit(1)).alias("n_set"), F.countDistinct("value").alias("n_values")).where("n_values > 1"),
    "tier_list": lambda s, d: _tiers(s, d).where("tier = 'core'").select("id"),
    "tier_moves": lambda s, d: _tiers(s, d).select("id", "tier", journal.moved_tier(F.col("tier"), 1).alias("promoted"), journal.moved_tier(F.col("tier"), -1).alias("demoted")),
    "decay_weights": _weights,
    "decay_list": lambda s, d: _weights(s, d).where("weight < 0.2 and not dead").select("id", "weight"),
    "decay_candidates": lambda s, d: journal.decay_candidates(_weights(s, d), _uses(s, d), 0.1, 60),
    "decay_dead": lambda s, d: _weights(s, d).where("dead").select("id"),
    "search_debug": lambda s, d: reports.debug_search(lexical.corpus(spread(table(s, d, "documents"))), "review"),
    "rejected_hypotheses": lambda s, d: reports.rejected(lexical.corpus(spread(table(s, d, "documents"))), "the"),
}

_SEV = "CASE WHEN value >= 75 THEN 'critical' WHEN value >= 50 THEN 'high' WHEN value >= 25 THEN 'medium' ELSE 'low' END"
_T = (
    "t AS (SELECT user_id::VARCHAR AS id, ts, event_id AS seq, event_type, floor(value)::BIGINT::VARCHAR AS v FROM events WHERE user_id IS NOT NULL),"
    " dr AS (SELECT id, max((ts, seq)) AS o FROM t WHERE event_type = 'error' {0} GROUP BY id),"
    " la AS (SELECT id, max_by(event_type, (ts, seq)) AS status, max_by(v, (ts, seq)) AS value, max((ts, seq)) AS o FROM t WHERE event_type <> 'error' {0} GROUP BY id),"
    " task AS (SELECT la.id, status, value FROM la LEFT JOIN dr ON la.id = dr.id WHERE dr.o IS NULL OR la.o > dr.o)"
)
_ALIAS = "al AS (SELECT lower(trim(alias)) AS id, max_by(lower(trim(canonical)), alias_no) AS canonical FROM aliases WHERE trim(alias) <> '' AND canonical IS NOT NULL GROUP BY 1)"
_TIER = "regexp_extract(regexp_extract(coalesce(text, ''), '(?s)\\A---\\r?\\n(.*?)\\r?\\n---', 1), '(?m)^tier: *([a-z]+)', 1)"
_TIERS = f"ti AS (SELECT doc_id::VARCHAR AS id, CASE WHEN {_TIER} IN ('core', 'recall', 'archival') THEN {_TIER} ELSE 'recall' END AS tier FROM documents)"
_W = (
    "u AS (SELECT user_id::VARCHAR AS id, max(ts) AS last_at, bool_or(coalesce(value >= {0}, false)) AS dead, count(ts) AS n_uses FROM events WHERE user_id IS NOT NULL GROUP BY 1),"
    " w AS (SELECT id, dead, n_uses, greatest(0, floor(date_diff('day', last_at::DATE, DATE '2024-02-10') / 4.0))::BIGINT AS n_decays FROM u),"
    " ww AS (SELECT id, CASE WHEN dead THEN 0 ELSE floor(pow(0.5, n_decays) * 1000000 + 0.5) / 1000000.0 END::DOUBLE AS weight, n_decays, dead, n_uses FROM w)"
).format(DEAD)
SQL: dict[str, str] = {
    "task_records": f"WITH {_T.format('')} SELECT * FROM task",
    "task_as_of": f"WITH {_T.format(f'AND ts <= TIMESTAMP {chr(39)}{AS_OF}{chr(39)}')} SELECT id, status FROM task",
    "task_history": f"SELECT user_id::VARCHAR AS id, event_id AS seq, CASE event_type WHEN 'error' THEN 'drop' ELSE 'set' END AS action, unnest(CASE event_type WHEN 'error' THEN ['drop'] ELSE ['status', 'value'] END) AS field, unnest(CASE event_type WHEN 'error' THEN ['error'] ELSE [event_type, floor(value)::BIGINT::VARCHAR] END) AS value FROM events WHERE user_id = {WHO}",
    "task_list": f"WITH {_T.format('')} SELECT id, value FROM task WHERE status = 'purchase'",
    "task_fields": f"WITH {_T.format('')} SELECT 'status' AS field, count(*) AS n, count(DISTINCT status) AS n_values FROM task UNION ALL SELECT 'value', count(*), count(DISTINCT value) FROM task",
    "channel_members": "SELECT event_type AS id, user_id::VARCHAR AS value, count(*) AS n FROM events GROUP BY 1, 2",
    "channel_sizes": "SELECT event_type AS id, count(DISTINCT user_id) AS n_members, count(*) AS n_entries FROM events GROUP BY 1",
    "channel_top": "WITH m AS (SELECT event_type AS id, user_id::VARCHAR AS value, count(*) AS n FROM events GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, value) AS pos FROM m QUALIFY pos <= 5",
    "agent_handoff": f"WITH {_T.format(f'AND ts <= TIMESTAMP {chr(39)}{AS_OF}{chr(39)}')}, x AS (SELECT * FROM task WHERE id = '{WHO}') SELECT 'heir' AS id, 'status' AS field, status AS value FROM x UNION ALL SELECT 'heir', 'value', value FROM x UNION ALL SELECT 'heir', 'handed_from', '{WHO}' FROM x",
    "incident_records": f"SELECT event_id::VARCHAR AS id, {_SEV} AS severity, user_id::VARCHAR AS affected FROM events WHERE event_type = 'error'",
    "incident_newest": f"SELECT id, severity, affected FROM (SELECT event_id, event_id::VARCHAR AS id, {_SEV} AS severity, user_id::VARCHAR AS affected FROM events WHERE event_type = 'error') WHERE severity IN ('high', 'critical') ORDER BY event_id DESC LIMIT 50",
    "alias_records": f"WITH {_ALIAS} SELECT * FROM al",
    "alias_list": f"WITH {_ALIAS} SELECT canonical, count(*) AS n_aliases, min(id) AS first_alias, max(id) AS last_alias FROM al GROUP BY canonical",
    "alias_history": "SELECT lower(trim(alias)) AS id, count(*) AS n_set, count(DISTINCT lower(trim(canonical))) AS n_values FROM aliases WHERE trim(alias) <> '' AND canonical IS NOT NULL GROUP BY 1 HAVING n_values > 1",
    "tier_list": f"WITH {_TIERS} SELECT id FROM ti WHERE tier = 'core'",
    "tier_moves": f"WITH {_TIERS} SELECT id, tier, CASE tier WHEN 'archival' THEN 'recall' ELSE 'core' END AS promoted, CASE tier WHEN 'core' THEN 'recall' ELSE 'archival' END AS demoted FROM ti",
    "decay_weights": f"WITH {_W} SELECT id, weight, n_decays, dead FROM ww",
    "decay_list": f"WITH {_W} SELECT id, weight FROM ww WHERE weight < 0.2 AND NOT dead",
    "decay_candidates": f"WITH {_W} SELECT id, weight, n_uses FROM ww WHERE NOT dead AND weight > 0.1 AND n_uses < 60",
    "decay_dead": f"WITH {_W} SELECT id FROM ww WHERE dead",
    "search_debug": "SELECT doc_id, source FROM documents WHERE source = 'debug' AND contains(lower(coalesce(text, '')), 'review')",
    "rejected_hypotheses": "WITH d AS (SELECT doc_id, coalesce(text, '') AS content FROM documents), h AS (SELECT doc_id, regexp_extract_all(content, '### H(\\d+): ([^\\n\\r]*)\\r?\\n(?:status: ([a-z]+))?', 1) AS a, regexp_extract_all(content, '### H(\\d+): ([^\\n\\r]*)\\r?\\n(?:status: ([a-z]+))?', 2) AS b, regexp_extract_all(content, '### H(\\d+): ([^\\n\\r]*)\\r?\\n(?:status: ([a-z]+))?', 3) AS c FROM d), y AS (SELECT doc_id, unnest(a)::INT AS no, unnest(c) AS status, unnest(b) AS hypothesis FROM h) SELECT doc_id, no, hypothesis FROM y WHERE status = 'rejected' AND contains(lower(hypothesis), 'the')",
}
