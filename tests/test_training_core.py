"""Problems 1, 2, 5 and 6 against row-at-a-time versions, and their edge cases."""

import pytest
from pyspark.sql import functions as F

from loam.functions.instants import parse_instants
from loam.operators.history import edge_history
from loam.operators.instants import normalised_values
from loam.operators.intervals import edge_periods, periods_and_gaps
from loam.operators.orphans import bad_references, reference_report
from loam.plans.ordered import bucketed
from tests import brute

EDGE = "id long, from_id string, relation string, to_id string, weight double, valid_from string, valid_until string, created_at string, graph_type string, agent string, key string, at long"
NODE = "node_no long, id string, node_type string, label string, metadata string, created_at string, updated_at string, agent string"
AGENT = "agent string, time_zone string, date_order string"


@pytest.fixture(scope="module", params=["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def data(request, spark):
    names = ("edges", "nodes", "aliases", "agents")
    frames = {t: spark.read.parquet(f"{request.param}/{t}.parquet") for t in names}
    return frames, {t: [r.asDict() for r in f.collect()] for t, f in frames.items()}


def rows(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_orphans(data):
    f, r = data
    assert rows(bad_references(f["edges"], f["nodes"], f["agents"])) == brute.p1(r["edges"], r["nodes"], r["agents"])


def test_orphan_report_adds_up(data):
    f, _ = data
    found = bad_references(f["edges"], f["nodes"], f["agents"]).count()
    total = reference_report(f["edges"], f["nodes"], f["agents"]).agg(F.sum(F.col("n_missing") + F.col("n_deleted") + F.col("n_late"))).first()[0]
    assert total == found > 0


def test_instants(data):
    f, r = data
    assert rows(normalised_values({t: f[t] for t in ("edges", "nodes", "aliases")}, f["agents"])) == brute.p2(r, r["agents"])


@pytest.mark.parametrize("target", [1_000_000, 7])
def test_periods(data, target):
    f, r = data
    assert rows(edge_periods(f["edges"], f["agents"], target)) == brute.p5(r["edges"], r["agents"])


@pytest.mark.parametrize("target", [1_000_000, 7])
def test_history(data, target):
    f, r = data
    assert rows(edge_history(f["edges"], f["agents"], target)) == brute.p6(r["edges"], r["agents"])


@pytest.mark.parametrize(
    "value, zone, order, expected",
    [
        ("1970-01-01", None, None, 0),
        ("1970-01-01T00:00:01.1234569Z", None, None, 1_123_456),
        ("2021-02-29", None, None, None),
        ("2021-02-28 24:00", None, None, None),
        ("0000-00-00", None, None, None),
        ("02/01/1970 00:00", None, None, 86_400_000_000),
        ("02/01/1970 00:00", "UTC", "MDY", 31 * 86_400_000_000),
        ("12:30 AM", None, None, None),
        ("Jan 1, 1970 12:05 am", None, None, 300_000_000),
        ("1970년 1월 1일 오후 1:00", "Asia/Seoul", "DMY", 4 * 3_600_000_000),
        ("2021-11-07 01:30", "America/New_York", None, 1636263000000000),  # first of two
        ("2021-03-14 02:30", "America/New_York", None, 1615707000000000),  # skipped: moves forward
        ("2021-03-14 02:30 EST", "America/New_York", None, 1615707000000000),
        ("2021-01-01 00:00 QQQ", None, None, None),
        ("2021-01-01 00:00:00 Mars/Base", None, None, None),
        ("19700102", None, None, 86_400_000_000),
        ("0000000001.5", None, None, 1_500_000),
        ("123", None, None, None),
        ("", None, None, None),
        (None, None, None, None),
        ("9" * 5000, None, None, None),
    ],
)
def test_single_instants(value, zone, order, expected):
    assert parse_instants([value], [zone], [order]).to_pylist() == [expected]


def test_empty_and_null_tables(spark):
    edges, nodes, agents = (spark.createDataFrame([], s) for s in (EDGE, NODE, AGENT))
    assert bad_references(edges, nodes, agents).collect() == []
    assert edge_periods(edges, agents).collect() == []
    assert edge_history(edges, agents).collect() == []
    nulls = spark.createDataFrame([(None,) * 12] * 3, EDGE)
    assert bad_references(nulls, nodes, agents).collect() == []
    assert edge_periods(nulls, agents).collect() == []
    one = spark.createDataFrame([(1, "A-b", None, " ", None, "2020-01-01", "now", None, "temporal", "nobody", "k", 5)] * 2, EDGE)
    assert {tuple(r) for r in bad_references(one, nodes, agents).collect()} == {(1, "from_id", "missing", "unknown")}
    assert [tuple(r) for r in edge_periods(one, agents).collect()] == [("ab", "", "period", 1577836800000000, -1)]


def test_touching_nested_and_open_intervals(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 1, 2), ("a", 9, 2**63 - 1), ("a", 10, 11), ("a", 0, 5)], "k string, start_us long, end_us long")
    for target in (1, 3, 100):
        assert rows(periods_and_gaps(df, ["k"], target)) == {("a", "period", 0, 7), ("a", "gap", 7, 9), ("a", "period", 9, -1)}


def test_bucketed_matches_plain_windows(spark):
    df = spark.range(0, 500).select(F.when(F.col("id") < 400, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), (F.col("id") * 37 % 1009).alias("t"), (F.col("id") % 5).alias("v"))
    plain = bucketed(df, ["k"], "t").running_total("v", "r", "all").neighbours({"p": "v"}, {"n": "t"})
    cut = bucketed(df, ["k"], "t", 50).running_total("v", "r", "all").neighbours({"p": "v"}, {"n": "t"})
    assert cut.hot and not plain.hot
    c = ["k", "t", "v", "r", "all", "p", "n"]
    assert sorted(map(tuple, cut.df.select(c).collect()), key=str) == sorted(map(tuple, plain.df.select(c).collect()), key=str)
