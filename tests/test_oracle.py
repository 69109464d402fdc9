"""Every core query with SQL gives the rows of DuckDB on the smallest tables; reports of problems 1 and 2 by brute force."""

import re
from collections import Counter

from loam.functions.instants import parse_instants
from loam.queries import context, extract, journal, memory, passes, records, reports, retrieval, stores, training
from tests import edge, oracle

MODULES = (training, retrieval, memory, reports, passes, stores, journal, extract, context, records)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and len(SQL) > 150
    assert len(QUERIES) == sum(len(m.QUERIES) for m in MODULES)


def test_rows_equal_those_of_duckdb(spark, small):
    def check(name, query):
        said = oracle.compare(spark, oracle.connect(small), small, query, SQL[name])
        assert said in ("", "no rows"), said

    assert edge.failures({k: QUERIES[k] for k in SQL}, check) == []


def test_reference_report_counts_the_references(spark, small):
    found = Counter((r["field"], r["period"], r["reason"]) for r in training.p1_found(spark, small).collect())
    report = training.p1_report(spark, small).collect()
    for r in report:
        assert all(found[r["field"], r["period"], reason] == r[f"n_{reason}"] for reason in ("missing", "deleted", "late"))
    assert sum(r["n_missing"] + r["n_deleted"] + r["n_late"] for r in report) == found.total()
    edges = spark.read.parquet(f"{small}/edges.parquet").collect()
    assert sum(r["n_references"] for r in report) == sum(1 for e in edges for f in ("from_id", "to_id") if e[f] and re.search(r"\w", e[f]))


def test_shape_report_counts_every_value(spark, small):
    agents = {r["agent"]: r for r in spark.read.parquet(f"{small}/agents.parquet").collect()}
    want, instants = Counter(), Counter()
    for name, fields in (("edges", ["created_at", "valid_from"]), ("nodes", ["updated_at"]), ("aliases", ["created_at"])):
        rows = spark.read.parquet(f"{small}/{name}.parquet").collect()
        for f in fields:
            who = [agents.get(r["agent"]) for r in rows]
            us = parse_instants([r[f] for r in rows], [w and w["time_zone"] for w in who], [w and w["date_order"] for w in who]).to_pylist()
            for r, u in zip(rows, us, strict=True):
                shape = r[f] and re.sub("[A-Za-z]", "a", re.sub("[0-9]", "9", r[f].strip(" ")))
                want[name, f, shape] += 1
                instants[name, f, shape] += u is not None
    got = {(r["source_table"], r["field"], r["shape"]): (r["n_values"], r["n_instants"]) for r in training.p2_shapes(spark, small).collect()}
    assert got == {k: (n, instants[k]) for k, n in want.items()}
