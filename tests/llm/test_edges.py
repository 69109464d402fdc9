"""Every optional query on empty tables, tables of nulls, and tables with clashing columns."""

import pytest

from loam.llm.queries import QUERIES
from tests import edge


@pytest.fixture(scope="module")
def folders(tmp_path_factory, small):
    return edge.build(str(tmp_path_factory.mktemp("edge")), small)


def test_empty_tables(spark, folders):
    def check(name, query):
        assert query(spark, folders["empty"]).collect() == []

    assert edge.failures(QUERIES, check) == []


def test_tables_of_nulls(spark, folders):
    def check(name, query):
        assert len(query(spark, folders["nulls"]).collect()) <= 3

    assert edge.failures(QUERIES, check) == []


def test_clashing_columns(spark, folders, small):
    def check(name, query):
        assert edge.rows(query(spark, folders["extra"])) == edge.rows(query(spark, small))

    assert edge.failures(QUERIES, check) == []
