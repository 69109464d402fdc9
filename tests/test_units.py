"""Text functions, files, streams, caches and plans of the core."""

import datetime

import pytest
from pyspark.sql import functions as F

from loam.functions import text
from loam.operators import fusion, lexical, lifecycle, stores
from loam.plans.ordered import bucketed
from loam.sources import notes
from loam.streaming import streams


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_tokens_and_slugs(spark):
    assert one(spark, text.tokens(F.col("t")), t="A Wörld of_가나 x 12") == ["wörld", "of_가나", "12"]
    assert one(spark, text.tokens(F.col("t")), t=None) == []
    assert one(spark, text.slug(F.col("t")), t="  Hello, World -- again ") == "hello-world-again"
    assert one(spark, text.ascii_slug(F.col("t")), t="!!!") == "untitled"
    assert one(spark, text.ascii_slug(F.col("t")), t="Ab c_한국") == "ab-c-한국"
    assert one(spark, text.strip_particle(F.col("t")), t="서울에서") == "서울"
    assert one(spark, text.strip_particle(F.col("t")), t="나는") == "나는"


def test_front_matter_and_links(spark):
    note = "---\ntier: core\ntags: [a, b]\n---\n# X [[a|b]] [[c]] [[a]]"
    assert one(spark, text.front_matter(F.col("t")), t=note) == {"tier": "core", "tags": "[a, b]"}
    assert one(spark, text.front_matter(F.col("t")), t="no") is None
    assert one(spark, text.links(F.col("t")), t=note) == ["a", "c"]


@pytest.mark.parametrize("n, size, overlap", [(0, 5, 1), (5, 5, 1), (6, 5, 1), (20, 5, 2), (21, 4, 0), (9, 3, 2)])
def test_chunks(spark, n, size, overlap):
    words = [f"w{i}" for i in range(n)]
    got = one(spark, text.chunks(F.col("t"), F.lit(size), overlap), t=" ".join(words))
    want, i = [], 0
    while n > size:
        want.append(" ".join(words[i : i + size]))
        if i + size >= n:
            break
        i += size - overlap
    assert got == (want or [" ".join(words)])


def test_query_forms():
    assert text.keyword_variants("who moved the storage quota review in Venmark") == ["moved storage quota review venmark", "moved storage quota"]
    assert text.subqueries("What is the owner of the archive?") == ["the archive", "owner"]
    assert text.subqueries("Ann's budget") == ["Ann", "budget"]


def test_scores_of_a_tiny_corpus(spark):
    docs = spark.createDataFrame([(1, "a", "x", "a", "one two", None), (2, "b", "x", "b", "alpha beta gamma delta", None), (3, "c", "x", "spanish", "x y z hello world bye", None)], "doc_id long, path string, dir string, stem string, content string, mtime timestamp")
    assert tuple(lexical.corpus_stats(docs).first()) == (3, 3.0)
    assert [r["doc_id"] for r in lexical.bm25_topk(docs, "beta hello").collect()] == [3, 2]
    assert lexical.bm25_topk(docs, "").collect() == [] and lexical.bm25_topk(docs, "absent").collect() == []
    assert [r["doc_id"] for r in lexical.search(docs, "spanish", "2024-01-01").collect()] == [3]


def test_rank_fusion(spark):
    lists = [spark.createDataFrame([(k, s) for k, s in zip(keys, (3.0, 2.0, 1.0), strict=True)], "doc_id string, score double") for keys in ("ABC", "BAD")]
    got = {r["doc_id"]: r["rrf_score"] for r in fusion.rrf(lists).collect()}
    assert got == {"A": pytest.approx(1 / 61 + 1 / 62), "B": pytest.approx(1 / 61 + 1 / 62), "C": pytest.approx(1 / 63), "D": pytest.approx(1 / 63)}
    with pytest.raises(ValueError):
        fusion.rrf(lists, k=0)


def test_carried_values_cross_buckets(spark):
    df = spark.createDataFrame([("k", i, f"v{i}" if i % 50 == 3 else None) for i in range(400)], "k string, t int, v string")
    for target in (1000, 30):
        rows = bucketed(df, ["k"], "t", target).carried("v", "c").df.orderBy("t").collect()
        assert [r["c"] for r in rows] == [None if i < 3 else f"v{(i - 3) // 50 * 50 + 3}" for i in range(400)]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "inbox").mkdir()
    fact = spark.range(1).select(notes.fact_line(F.lit("role"), F.lit("CEO"), F.lit("2020-01-01"), F.lit(None).cast("string"), F.lit("2020-02-02")).alias("x")).first()["x"]
    line = spark.range(1).select(notes.timeline_line(F.lit("2024-01-02"), F.lit("met"), F.lit("Ann")).alias("x")).first()["x"]
    (tmp_path / "inbox" / "a.md").write_text(f"# A\n{fact}\n{line}\n", encoding="utf-8")
    (tmp_path / "RESOLVER.md").write_text("x")
    docs = notes.read_notes(spark, str(tmp_path)).withColumn("doc_id", F.lit(1))
    assert [(r["dir"], r["stem"]) for r in docs.collect()] == [("inbox", "a")]
    assert [tuple(r) for r in lifecycle.fact_lines(docs).collect()] == [(1, "role", "CEO", "2020-01-01", None, "2020-02-02")]
    assert [tuple(r) for r in lifecycle.timeline(docs).collect()] == [(1, 2, "2024-01-02", "met", "Ann")]
    log = spark.createDataFrame([("2024-01-01T00:00", "x", ["t"], "high", None, None, None)], "ts string, event string, tags array<string>, importance string, entity string, task string, decision string")
    notes.write_events_log(log, str(tmp_path / "log"))
    assert notes.read_events_log(spark, str(tmp_path / "log")).count() == 1
    notes.write_report(log.drop("tags"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["event"] == "x"


def test_watched_folder(spark, tmp_path):
    seen = []
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("hello")
    act = lambda batch, n: seen.extend(r["content"] for r in batch.collect())
    streams.watch(spark, str(tmp_path / "in"), act, str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in" / "b.md").write_text("again")
    streams.watch(spark, str(tmp_path / "in"), act, str(tmp_path / "cp")).awaitTermination()
    assert seen == ["hello", "again"]


def test_windowed_stream(spark, tmp_path):
    rows = [(i, datetime.datetime(2024, 1, 1, i % 3), 1, "view", 1.0, "") for i in range(9)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "e"))
    counts = streams.windowed(streams.read_events(spark, str(tmp_path / "e"), schema))
    query = counts.writeStream.outputMode("complete").format("memory").queryName("windowed_test").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["n"] for r in spark.table("windowed_test").collect()) == [3, 3, 3]


def test_contradicting_wordings(spark):
    cases = [("role: ceo", "role: cto", True), ("the door is open", "the door is closed", True), ("a b", "a c", False)]
    df = spark.createDataFrame(cases, "a string, b string, w boolean")
    assert all(r["x"] == r["w"] for r in df.select(stores.opposing(F.col("a"), F.col("b")).alias("x"), "w").collect())
    assert one(spark, stores.modality(F.col("t")), t="x/y.PNG") == "image" and one(spark, stores.modality(F.col("t")), t="x") == "binary"


def test_cache_forgets_by_age_size_and_version():
    now = [0.0]
    cache = stores.QueryCache(2, 10, lambda: now[0])
    assert cache.get("a", 1, lambda: 1) == 1 and cache.get("a", 1, lambda: 2) == 1 and cache.get("a", 2, lambda: 3) == 3
    now[0] = 11
    assert cache.get("a", 1, lambda: 4) == 4 and cache.get("b", 1, lambda: 5) == 5 and cache.get("a", 2, lambda: 6) == 6
    assert len(cache.rows) == 2 and cache.hits == 1
