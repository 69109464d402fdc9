"""Similar bullet lines against all pairs."""

import random

from loam.operators.reports import similar_lines, word_ratio


def classes(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    return {(r["doc_id"], r["line_no"]): r["class_line"] for r in similar_lines(docs).collect()}


def test_one_word_a_typo_and_an_insert_link(spark):
    base = "- the team moved the old budget review to the next week"
    kin = [base, base.replace("old", "new"), base.replace("review", "reveiw"), base.replace("the next", "the very next"), base + " [Source: Ann]", "  " + base + "\r"]
    other = ["- city: Oslo <!-- valid:[2020-01-01..2021-01-01] recorded:2022-01-01T08:00 -->", "- city: Rome <!-- valid:[2020-02-01..2021-03-01] recorded:2022-04-01T08:00 -->"]
    got = classes(spark, ["# x\n" + "\n".join(kin[:2]), *kin[2:], *other, "- alone among the lines", "- short", None, ""])
    least = min(x.strip() for x in kin[:4])
    assert got == {(0, 1): least, (0, 2): least} | {(i, 0): least for i in range(1, 5)} | {(5, 0): other[0], (6, 0): other[1], (7, 0): "- alone among the lines"}


def test_classes_equal_all_pairs(spark):
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(12)] + [f"rare{i}" for i in range(60)]
    lines = ["- " + " ".join(random.choices(vocabulary, k=random.randint(4, 24))) for _ in range(60)]
    for line in list(lines):
        for _ in range(4):
            words = line.split()[1:]
            for _ in range(random.randint(1, 4)):
                at = random.randrange(len(words))
                words[at : at + random.randint(0, 1)] = random.choices(vocabulary, k=random.randint(0, 2))
                words = words or ["w0"]
            lines.append("- " + " ".join(words))
    lines = [x for x in lines if len(x) > 10]
    up = {x: x for x in lines}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            if word_ratio(a, b) >= 0.85:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    got = classes(spark, lines)
    assert got == {(i, 0): top(x) for i, x in enumerate(lines)}
    assert 60 < len(set(got.values())) < len(set(lines))


def test_no_lines_are_broadcast(spark, tmp_path, monkeypatch):
    """Files of few bytes hold many lines; at Spark's own threshold the driver was to hold all of them."""
    from loam.operators import reports

    base = "- the team moved the old budget review to the next week"
    texts = [base, base.replace("old", "new"), base.replace("review", "reveiw"), "- alone among the lines"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string").write.parquet(str(tmp_path / "docs"))
    plans, cut = [], reports.cut
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(reports, "cut", lambda df: (plan(df), cut(df))[1])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        got = similar_lines(spark.read.parquet(str(tmp_path / "docs")))
        plan(got)
        assert len(plans) >= 5 and sum("SortMergeJoin" in p for p in plans) >= 4
        assert not [p for p in plans if "Broadcast" in p]
        assert sorted((r["doc_id"], r["class_line"]) for r in got.collect()) == [(i, min(texts[:3])) for i in range(3)] + [(3, texts[3])]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
