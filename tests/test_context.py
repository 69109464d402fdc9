"""Strategies, rendering, conflicts, fuzzy ratios and instants against rows worked out by hand or by brute force."""

import re
from collections import Counter
from datetime import datetime, timezone
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from loam.functions import text
from loam.functions.instants import parse_instants
from loam.operators import context, extract, journal, lexical, ranking, records, stores
from loam.queries.context import QUERIES
from loam.queries.retrieval import AS_OF

DOCS = "doc_id long, path string, dir string, stem string, content string, mtime timestamp, entity string"


def docs(spark, texts, stems=None):
    rows = [(i, f"x/{i}.md", "base", (stems or {}).get(i, f"n{i}"), t, None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("question, days", [("what changed in the past 3 weeks", 21), ("last year", 365), ("지난 2개월 동안", 60), ("지난달 회의", 30), ("how often lately", 30), ("who is Ann", None), ("last 0 days", 1)])
def test_time_windows(question, days):
    got = context.time_window(question, "2024-03-31")
    assert got is None if days is None else (datetime.fromisoformat(got[1]) - datetime.fromisoformat(got[0])).days == days


@pytest.mark.parametrize("question, kind", [("How many times did I go", "counting"), ("compare Ann and Bo", "multi_session"), ("what is current", "knowledge_update"), ("what did Ann say", "single_session"), ("before lunch", "temporal_reasoning"), ("I love tea", "preference"), ("xyz", "general")])
def test_question_types(question, kind):
    assert context.question_type(question) == kind


def test_fuzzy_ratio_is_that_of_difflib(spark):
    texts = ["  Storage quota review  \nsomething else", "storge", "q" * 250 + "storage quota", "", "ÄÖ storage", "stor\tage"]
    found = docs(spark, texts, {3: "storage-quota", 1: "zz"})
    queries = ["storge qouta", "storage", "review of storage quota"]
    rows = found.select("doc_id", lexical.similarity(queries)(F.col("content"), F.lower(F.translate("stem", "-", " "))).alias("r")).collect()
    for r in rows:
        name = {3: "storage quota", 1: "zz"}.get(r["doc_id"], f"n{r['doc_id']}")
        for q, got in zip(queries, r["r"], strict=True):
            lines = [x.strip() for x in texts[r["doc_id"]].lower().split("\n")] + [name]
            assert got == max(SequenceMatcher(None, q, x).ratio() for x in lines)


def test_fuzzy_search_of_whole_tables(spark, small):
    from loam.queries.retrieval import QUERIES as RETRIEVAL

    got = [(r["doc_id"], r["score"]) for r in RETRIEVAL["fuzzy_search"](spark, small).collect()]
    assert len(got) == 20 and got == sorted(got, key=lambda x: (-x[1], x[0]))
    # no document holds the misspelt words, so a score is a quarter of the ratio, with the recent dates' bonus
    text_of = {r["doc_id"]: r for r in lexical.corpus(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    for i, score in got:
        r = text_of[i]
        ratio = max(SequenceMatcher(None, "storge qouta", x).ratio() for x in [*(x.strip() for x in r["content"].lower().split("\n")), r["stem"].lower().replace("-", " ")])
        assert any(abs(score - int(100 * (0.25 * ratio + b) + 0.5) / 100) < 0.011 for b in (0, 0.02, 0.05))


def test_file_name_counts_as_words(spark):
    found = docs(spark, ["nothing", "nothing"], {0: "quota-plan", 1: "quotations"})
    assert [r["doc_id"] for r in lexical.search(found, "quota", AS_OF).collect()] == [0, 1]  # the letters are in both names ...
    scores = {r["doc_id"]: r["score"] for r in lexical.search(found, "quota budget", AS_OF).collect()}
    assert list(scores) == [0]  # ... but only one name has the word


def test_snippets(spark):
    note = "# T\n\nfirst line\nsecond storage line\nthird storage quota\nfourth\nfifth\nsixth\nseventh"
    one = lambda q, p=None: spark.range(1).select(text.snippet(F.lit(note), text.tokens_of(q), phrase=p).alias("x")).first()["x"]
    assert one("storage quota") == "first line | second storage line | third storage quota | fourth | fifth | sixth"
    assert one("storage") == "# T | first line | second storage line | third storage quota | fourth | fifth"
    assert one("absent") == "" and one("quota", "sixth") == "third storage quota | fourth | fifth | sixth | seventh"


def test_conflicts_against_brute_force(spark, small):
    new = "Rosa Tenfilrusk approved the storage quota"
    bullets = extract.bullet_facts(lexical.corpus(spark.read.parquet(f"{small}/documents.parquet")))
    got = {(r["doc_id"], r["line_no"]) for r in context.conflicting(bullets, new).collect()}

    def opposed(old, low, ratio):
        if any((a in old and b in low) or (b in old and a in low) for a, b in stores.OPPOSED):
            return True
        a, b = old.split(), low.split()
        return 0.6 < ratio < 0.95 and len(a) > 2 and len(b) > 2 and a[:2] == b[:2] and a[2:] != b[2:]

    want = set()
    for r in bullets.collect():
        old, low = r["fact"].lower().strip(), new.lower()
        ratio = SequenceMatcher(None, old, low).ratio()
        if old != low and ratio >= 0.4 and opposed(old, low, ratio):
            want.add((r["doc_id"], r["line_no"]))
    assert got == want


def test_conflicts_by_hand(spark):
    facts = ["Ann leads the garden team", "Ann leads the garden team well", "the door is open", "Role: cook", "something else"]
    rows = spark.createDataFrame([(1, i, f) for i, f in enumerate(facts)], "doc_id long, line_no int, fact string")
    lines = lambda new: sorted(r["line_no"] for r in context.conflicting(rows, new).collect())
    assert lines("the door is closed") == [2] and lines("role: pilot") == [3] and lines("Ann leads the garden crew") == [0, 1] and lines("Ann leads the garden team") == [1]


def test_intent_needs_whole_words(spark):
    cases = [("I'm thinking of getting an orchid", True), ("told him thinking about it", False), ("maybe I'll grab it", True), ("살까 고민", True), ("bought it", False)]
    df = spark.createDataFrame(cases, "t string, w boolean")
    assert all(r["x"] == r["w"] for r in df.select(F.lower("t").rlike(ranking.INTENT).alias("x"), "w").collect())


def test_modalities(spark):
    kinds = {"a/x.PNG": "image", "x.heic": "image", "x.html": "code", "x.json": "code", "x.yaml": "code", "x.pdf": "binary", "x": "binary", "x.tsx": "code", "x.rst": "text", "x.opus": "audio"}
    df = spark.createDataFrame(list(kinds.items()), "p string, w string")
    assert all(r["x"] == r["w"] for r in df.select(stores.modality(F.col("p")).alias("x"), "w").collect())


def test_chunk_sizes_follow_characters(spark):
    size = lambda n: spark.range(1).select(text.chunk_size(F.lit(n)).alias("x")).first()["x"]
    assert [size(n) for n in (0, 499, 500, 600, 2000, 2001)] == [128, 128, 256, 256, 256, 512]


def test_annotations(spark):
    rows = [("x", "2020", None, None, "[2020 ~ present] x"), ("x", "2020", "2021", "2022", "[recorded: 2022, valid: 2020 ~ 2021] x"), ("x", None, None, "2022", "[recorded: 2022] x"), ("x", None, None, None, "x"), ("[a ~ b] x", "2020", None, None, "[a ~ b] x")]
    df = spark.createDataFrame(rows, "t string, a string, b string, r string, w string")
    assert all(r["x"] == r["w"] for r in df.select(context.annotated(F.col("t"), F.col("a"), F.col("b"), F.col("r")).alias("x"), "w").collect())


def test_dispatch(spark, small):
    found = QUERIES["dispatch_general"](spark, small).collect()
    assert found and {(r["question_type"], r["strategy"]) for r in found} == {("general", "general")}
    notes = lexical.corpus(spark.read.parquet(f"{small}/documents.parquet"))
    edges = spark.read.parquet(f"{small}/edges.parquet")
    assert context.dispatched(notes, edges, None, " ", AS_OF).collect() == []
    for q in ("how many storage quotas", "compare storage quota and budget", "storage quota before budget", "I love the storage quota", "what did Ann say about storage quota"):
        rows = context.dispatched(notes, edges, None, q, AS_OF).collect()
        assert 0 < len(rows) <= 5 and {r["question_type"] for r in rows} == {context.question_type(q)}
    assert {r["strategy"] for r in context.dispatched(notes, edges, None, "zzqx anymore", AS_OF).collect()} <= {"knowledge_update, fuzzy"}


def test_graph_paths_and_prepared_context(spark, small):
    paths = QUERIES["graph_paths"](spark, small).collect()
    assert [r["pos"] for r in paths] == list(range(1, len(paths) + 1)) and any(r["text"].startswith("shared-inbox-relay --") for r in paths)
    lines = [r["line"] for r in QUERIES["prepared_context"](spark, small).orderBy("pos").collect()]
    assert lines and sum(map(len, lines)) < 7000 and all(x.startswith(("[high", "[medium", "[low", "---")) for x in lines)


def test_log_views(spark):
    rows = [("t", "a", "2024-01-01 00:00:00", 1, "set", "s", "new"), ("t", "a", "2024-01-02 00:00:00", 2, "set", "s", "done"), ("t", "a", "2024-01-02 00:00:00", 1, "set", "s", "old"), ("t", "b", None, 1, "set", "s", "x"),
            ("t", "b", "2024-01-03 00:00:00", 2, "drop", None, None), ("t", "c", "2024-01-01 00:00:00", 1, "set", "s", "x"), ("t", "c", "2024-01-05 00:00:00", 1, "unset", "s", None), ("t", "d", "2024-01-04 00:00:00", 1, "add", "m", "p"), ("t", "d", "2024-01-05 00:00:00", 1, "add", "m", "p")]
    log = spark.createDataFrame(rows, "store string, id string, at string, seq long, action string, field string, value string").withColumn("at", F.col("at").cast("timestamp")).select(*journal.COLUMNS)
    got = lambda **k: {r["id"]: r["s"] for r in journal.records(log, "t", ["s"], **k).collect()}
    assert got() == {"a": "done"}
    assert got(as_of="2024-01-01 12:00:00") == {"a": "new", "c": "x"}
    assert [tuple(r)[:3] for r in journal.members(log, "t", "m").collect()] == [("d", "p", 2)]
    assert journal.appended(log, log).count() == log.count()
    moved = {(r["id"], r["field"], r["value"]) for r in journal.handed_over(log, "t", "a", "z", "2024-02-01 00:00:00").collect()}
    assert moved == {("z", "s", "done"), ("z", "handed_from", "a")}
    assert journal.records(log.limit(0), "t", ["s"]).collect() == []


def test_wall_clock_times_outside_the_tables():
    def us(*args):
        return int((datetime(*args, tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) * 1_000_000

    values = ["2150-07-01 12:00:00", "2150-01-01 12:00:00", "2023-07-01 12:00:00"]
    assert parse_instants(values, ["America/New_York"] * 3, [None] * 3).to_pylist() == [us(2150, 7, 1, 16), us(2150, 1, 1, 17), us(2023, 7, 1, 16)]


def test_tables_runbooks_and_attachments(spark):
    note = "| Name | Role | City |\n|---|---|---|\n| Ann Lee | cook | Oslo |\n| x | y |\n- [2024-01-02] asked about the budget\n[[plan.pdf]] ![[map.PNG]] (a/b.mp3)"
    found = docs(spark, [note, ""])
    assert [tuple(r) for r in records.table_rows(found).collect()] == [(0, 1, "Ann Lee", "cook | Oslo")]
    assert [tuple(r) for r in records.list_items(found).collect()] == [(0, 4, "asked about the budget")]
    assert {tuple(r) for r in records.attachments(found).collect()} == {(0, "plan.pdf", "binary"), (0, "map.PNG", "image"), (0, "a/b.mp3", "audio")}
    hits = spark.createDataFrame([(0, 1.0), (1, 0.5)], "doc_id long, score double")
    assert [tuple(r) for r in records.hits_with_attachments(hits, records.attachments(found), "audio").collect()] == [(0, 1.0, 1)]
    books = spark.createDataFrame([(1, "disk .* full", 0.5), (2, "disk is full", 0.0), (3, "network", 0.9), (4, "(", None), (5, None, None)], "id long, pattern string, confidence double")
    want = {1: 0.6 + 0.2, 2: 0.6 * SequenceMatcher(None, "disk c is full", "disk is full").ratio(), 3: 0.6 * SequenceMatcher(None, "disk c is full", "network").ratio() + 0.36}
    got = {r["id"]: r["score"] for r in records.runbook_matches(books, "Disk C is full").collect()}
    assert got == {k: pytest.approx(v, abs=1e-4) for k, v in want.items()}
    assert records.runbook_matches(books, " ").collect() == []


def test_routes_keys_and_answers(spark):
    texts = {"We decided": "decision", "a TODO": "task", "the founder": "entity", "": "entity"}
    df = spark.createDataFrame(list(texts.items()), "t string, w string")
    assert all(r["x"] == r["w"] for r in df.select(records.route_of(F.col("t")).alias("x"), "w").collect())
    answers = spark.createDataFrame([("a", "The  Cat!", "the cat"), ("a", "a big cat", "cat"), ("b", "I don't know.", "x"), ("b", None, "")], "category string, predicted string, gold string")
    got = {r["category"]: (r["n"], r["exact"], r["contains"], r["abstained"]) for r in records.scored_answers(answers).collect()}
    assert got == {"a": (2, 0.5, 1.0, 0.0), "b": (2, 0.5, 0.0, 0.5), "(all)": (4, 0.5, 0.5, 0.25)}
    keys = spark.createDataFrame([("f", None, None, None, None, None, None), (None, "E", "k", "v", None, None, None), (None, None, None, None, "r", "T", "s"), (None, None, None, None, None, "T", None)], "file string, entity string, key string, value string, relation string, target string, seed string")
    assert [r["k"].split("\x1f") for r in keys.select(records.hit_key(*[F.col(c) for c in keys.columns]).alias("k")).collect()] == [["file", "f"], ["fact", "e", "k", "v"], ["graph", "t", "r", "s"], ["entity", "t"]]


def test_keywords_of_conversations(spark, small):
    from loam.operators.reports import STOPS

    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = {r["doc_id"]: r["keywords"] for r in records.document_summaries(lexical.corpus(spark.read.parquet(f"{small}/documents.parquet"))).collect()}
    for r in rows:
        t = r["text"] or ""
        said = " ".join(re.findall(r"\[USER\](.*?)(?=\[(?:USER|ASSISTANT|SYSTEM)\]|$)", t, re.S)) or t
        n = Counter(w for w in re.findall("[a-z]{3,}", said.lower()) if w not in STOPS)
        assert got[r["doc_id"]] == ",".join(w for w, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:10])


@pytest.mark.parametrize("query", ["it's a \\ test's \\d {x} %s", "naïve 'quoted'", "\"double\" \\Q..\\E", "", "  "])
def test_odd_queries(spark, query):
    found = docs(spark, [f"# {query}\nsome text with {query} in it", "nothing of the kind", ""])
    hits = [r["doc_id"] for r in lexical.search(found, query, AS_OF).where("score >= 1").collect()]
    assert hits == [0] if query.strip() else set(hits) <= {0, 1, 2}
    assert {r["doc_id"] for r in lexical.bm25_topk(found, query).collect()} <= {0}
    assert lexical.expanded(found, query, AS_OF).collect() is not None


def test_goal_lifts_by_hand(spark):
    texts = ["alpha beta\ngamma", "alpha\nWhen: beta alpha | x", "tier: core\nzzz", "Confidence: verified and Confidence: hypothesis qq"]
    hits = spark.createDataFrame([(i, 0.1, t) for i, t in enumerate(texts)], "doc_id long, score double, content string")
    ratio = lambda t: max(SequenceMatcher(None, "alpha beta", x.strip()).ratio() for x in t.lower().split("\n"))
    fit = [0.3, 0.2 * 1.0, 0.0, 0.0]  # the whole goal, or a fifth of the share of its words
    other = [0.0, 0.03, 0.03, 0.05 * (1 + 0.4) / 2]  # conditions, core notes, trust
    kind = [0.05 * 0.5, 0.05 * 0.5, 0.05 * 0.9, 0.05 * 0.5]  # "core" is a word of identity
    got = {r["doc_id"]: r["score"] for r in stores.goal_rerank(hits, "alpha beta").collect()}
    assert got == {i: pytest.approx(0.1 + fit[i] + 0.15 * ratio(t) + other[i] + kind[i]) for i, t in enumerate(texts)}


def test_counting_sweep_against_its_searches(spark, small):
    from loam.operators import routing

    question = "how many storage quota reviews"
    found = lexical.corpus(spark.read.parquet(f"{small}/documents.parquet"))
    edges = spark.read.parquet(f"{small}/edges.parquet").select("from_id", "to_id")
    words = [t for t in dict.fromkeys(text.tokens_of(question)) if len(t) > 3]
    want = {}
    for name, queries in (("query", [question]), ("variants", text.keyword_variants(question)), ("words", words)):
        for q in queries:
            for r in lexical.search(found, q, AS_OF, 30).collect():
                best, passes = want.setdefault(r["doc_id"], [0.0, set()])
                want[r["doc_id"]] = [max(best, r["score"]), passes | {name}]
    near = {(e["to_id"] or "").lower() for e in edges.collect() if e["from_id"] and any(t in e["from_id"].lower() for t in text.tokens_of(question))}
    for r in found.where("entity is not null").select("doc_id", "entity").collect():
        if r["entity"].lower() in near:
            best, passes = want.setdefault(r["doc_id"], [0.0, set()])
            want[r["doc_id"]] = [max(best, 0.3), passes | {"neighbours"}]
    got = {r["doc_id"]: (r["score"], r["passes"]) for r in routing.counting(found, edges, question, AS_OF).collect()}
    assert got == {k: (pytest.approx(b + min(0.08, 0.02 * (len(p) - 1))), ",".join(sorted(p))) for k, (b, p) in want.items()} and len(got) > 10
