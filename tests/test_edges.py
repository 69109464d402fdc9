"""Every core query on empty tables, tables of nulls, and tables with clashing columns."""

import pytest

from loam.queries import context, extract, journal, memory, passes, records, reports, retrieval, stores, training
from tests import edge

QUERIES = {k: f for m in (training, retrieval, memory, reports, passes, stores, journal, extract, context, records) for k, f in m.QUERIES.items()}
CLASHING = ["p1_found", "p2_found", "p5_found", "p6_found", "composite_search", "fact_as_of", "fact_asof_join", "fact_contradictions", "neighbors_2hop", "link_graph", "auto_tier", "compact", "statements", "flush_sections", "three_pass_search", "task_records", "alias_records", "extract_relations", "bullet_facts", "rendered_hits", "fact_settle", "graph_similar_all"]


@pytest.fixture(scope="module")
def folders(tmp_path_factory, small):
    return edge.build(str(tmp_path_factory.mktemp("edge")), small)


def test_empty_tables(spark, folders):
    def check(name, query):
        df = query(spark, folders["empty"])
        assert len(df.collect()) <= 12 and df.columns  # reports of totals have rows of zeros

    assert edge.failures(QUERIES, check) == []


def test_tables_of_nulls(spark, folders):
    def check(name, query):
        assert len(query(spark, folders["nulls"]).collect()) <= 20

    assert edge.failures(QUERIES, check) == []


def test_clashing_columns(spark, folders, small):
    def check(name, query):
        assert edge.rows(query(spark, folders["extra"])) == edge.rows(query(spark, small))

    assert edge.failures({n: QUERIES[n] for n in CLASHING}, check) == []
