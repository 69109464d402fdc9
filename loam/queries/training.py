"""Queries p1, p2, p5 and p6 over the driver's tables."""

from __future__ import annotations

from loam.operators.history import edge_history
from loam.operators.instants import normalised_values, shape_report
from loam.operators.intervals import edge_periods
from loam.operators.orphans import bad_references, reference_report
from loam.sources.tables import table


def p1_found(spark, d):
    return bad_references(table(spark, d, "edges"), table(spark, d, "nodes"), table(spark, d, "agents"))


def p1_report(spark, d):
    return reference_report(table(spark, d, "edges"), table(spark, d, "nodes"), table(spark, d, "agents"))


def p2_found(spark, d):
    return normalised_values({t: table(spark, d, t) for t in ("edges", "nodes", "aliases")}, table(spark, d, "agents"))


def p2_shapes(spark, d):
    return shape_report({t: table(spark, d, t) for t in ("edges", "nodes", "aliases")}, table(spark, d, "agents"))


def p5_found(spark, d):
    return edge_periods(table(spark, d, "edges"), table(spark, d, "agents"))


def p6_found(spark, d):
    return edge_history(table(spark, d, "edges"), table(spark, d, "agents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_shapes, p5_found, p6_found)}
SQL: dict[str, str] = {}
