"""Extraction against Python's own patterns, over whole tables and on sentences made by hand."""

import re

import pytest
from pyspark.sql import functions as F

from loam.operators import extract
from loam.queries.extract import QUERIES

SCHEMA = "doc_id long, content string"


def rows(spark, df):
    return {tuple(r) for r in df.collect()}


def strip(word):
    if not re.search("[가-힯]", word):
        return word
    pattern = re.compile("(?:" + "|".join(sorted(extract.NAME_PARTICLES, key=len, reverse=True)) + ")$")
    for _ in range(4):
        less = pattern.sub("", word)
        if less == word or len(less) < 2:
            break
        word = less
    return word


def brute_relations(text):
    out = set()
    for kind, patterns in (("en", extract.RELATIONS), ("ko", extract.KOREAN_RELATIONS), ("causal", extract.CAUSES)):
        for p, relation in patterns:
            for m in re.finditer(p, text, re.IGNORECASE if kind == "en" else 0):
                a, b = (m[i].lower() if kind == "en" else strip(m[i]).lower().strip() for i in (1, 2))
                single = "[가-힯]" if kind == "ko" else "[가-힯一-鿿]"
                if any(not x or (len(x) < 2 and (kind == "en" or not re.search(single, x))) for x in (a, b)):
                    continue
                stops = set(extract.STOPS) | (set(extract.KOREAN_STOPS) if kind != "en" else set())
                if {a, b} & stops or (kind != "en" and a == b):
                    continue
                if kind == "causal" and relation == "caused_by":
                    a, b = b, a
                out.add((a, relation, b, "causal" if kind == "causal" else "entity"))
    return out


SENTENCES = [
    "Alice works at Acme. Bob worked for Initech, and Carol lives in Paris.",
    "Dave moved to Berlin; Erin loves green tea. Frank is a doctor.",
    "Grace knows Heidi. Ivan studied at Oxford and graduated from Oxford. Judy's hobby is chess playing. Ken born in Oslo.",
    "서준이는 서울에서 일한다. 민수는 부산에 산다. 지영은 커피를 좋아한다. 철수는 영희와 결혼했다.",
    "폭우 때문에 지연이 생겼다. Rain caused Flooding. Bugs led to Outages. Effort resulted in Success. 大雨导致洪水",
    "The is a the. a works at B. ",
    "",
]


def test_relations_by_hand(spark):
    got = rows(spark, extract.relations(spark.createDataFrame(list(enumerate(SENTENCES)), SCHEMA)))
    want = {(i, *r) for i, t in enumerate(SENTENCES) for r in brute_relations(t)}
    assert got == want
    expected = {
        (0, "alice", "works_at", "acme", "entity"), (0, "bob", "works_at", "initech", "entity"), (0, "carol", "lives_in", "paris", "entity"), (1, "dave", "lives_in", "berlin", "entity"),
        (1, "erin", "likes", "green tea", "entity"), (1, "frank", "is_a", "doctor", "entity"), (2, "grace", "knows", "heidi", "entity"), (2, "judy", "hobby_is", "chess playing", "entity"),
        (3, "민수", "lives_in", "부산", "entity"), (4, "flooding", "caused_by", "rain", "causal"), (4, "outages", "caused_by", "bugs", "causal"), (4, "effort", "resulted_in", "success", "causal"),
    }
    assert expected <= got


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}


def test_relations_of_whole_tables(spark, small, texts):
    assert rows(spark, QUERIES["extract_relations"](spark, small)) == {(i, *r) for i, t in texts.items() for r in brute_relations(t)}


def test_words_and_fields_of_whole_tables(spark, small, texts):
    def words(t):
        found = [w.lower() for w in re.findall(r"\b[A-Z][a-zA-Z]{2,}\b", t) if w.lower() not in extract.STOPS] + re.findall("[가-힯]{2,}", t)
        return ",".join(list(dict.fromkeys(found))[:6])

    assert dict(rows(spark, QUERIES["named_words"](spark, small))) == {i: words(t) for i, t in texts.items()}

    def fields(t):
        for n, line in enumerate(t.split("\n")):
            for name, patterns in extract.STATES.items():
                m = next((m for p in patterns if (m := re.search(p, line, re.IGNORECASE))), None)
                if m and m[1].strip(" .;"):
                    yield n, name, m[1].strip(" .;")[:200]

    assert rows(spark, QUERIES["state_fields"](spark, small)) == {(i, *f) for i, t in texts.items() for f in fields(t)}

    def facts(t):
        found = [f"{m[1]}: {m[2]}" for p in extract.KEY_FACTS for m in re.finditer(p, t, re.IGNORECASE)]
        return " | ".join(list(dict.fromkeys(found))[:15])

    got = dict(rows(spark, QUERIES["key_facts"](spark, small)))
    assert {i: v for i, v in got.items() if facts(texts[i])} == {i: facts(t) for i, t in texts.items() if facts(t)}


def test_small_extractors(spark):
    note = (
        "tags: a, b\n- **2024-01-02** | met Ann Lee [Source: Bo]\n- ⏳ waits for the answer\nWhen: rain or snow | When NOT: sunny days]\n"
        "## Evidence Log\n- **2024-03-04** | [H2] test run supports: it failed twice\n## Conclusion\ndone\n\n---\nx [[Ann Lee|Ann]] y"
    )
    docs = spark.createDataFrame([(1, note), (2, None), (3, "")], SCHEMA).withColumn("content", F.coalesce("content", F.lit("")))
    assert rows(spark, extract.bullet_facts(docs)) == {(1, 1, "met Ann Lee"), (1, 2, "waits for the answer"), (1, 5, "[H2] test run supports: it failed twice")}
    assert rows(spark, extract.conditions(docs)) == {(1, "when", "rain or snow"), (1, "when_not", "sunny days")}
    assert rows(spark, extract.evidence_rows(docs)) == {(1, "2024-03-04", "H2", "supports", "it failed twice")}
    assert rows(spark, docs.select("doc_id", extract.tag_of(F.col("content")))) == {(1, "a, b"), (2, ""), (3, "")}
    assert docs.select(extract.section_of(F.col("content"), "Conclusion").alias("x")).first()["x"] == "done"
    assert [r["target"] for r in extract.link_context(docs).collect()] == ["Ann Lee"]
    got = {r["doc_id"]: r["b"] for r in docs.select("doc_id", extract.condition_bonus(F.col("content"), "snow and rain").alias("b")).collect()}
    assert got == {1: 0.02, 2: 0.0, 3: 0.0}
    assert spark.range(1).select(extract.signature(F.lit("The quick brown foxes jumped over lazy")).alias("x")).first()["x"] == "brown-foxes-jumped-quick"
    persona = "Name: Kim Lee\nGender Identity: female\nRacial Identity: x\nA 34-year-old; is a 34 year old teacher who loves hiking, enjoys tea. hates noise."
    told = rows(spark, extract.personas(spark.createDataFrame([(1, persona)], SCHEMA)))
    assert {(1, "name", "Kim Lee"), (1, "gender", "female"), (1, "age", "34"), (1, "profession", "teacher"), (1, "like", "hiking"), (1, "like", "tea"), (1, "dislike", "noise")} <= told
