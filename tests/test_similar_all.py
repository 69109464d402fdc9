"""Nearest labels of all queries against every pair, and how many pairs are multiplied for it."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from loam.operators import nearest
from loam.operators.context import similar_all

FIRST = ["Uwe", "Kofi", "Noor", "Zofia", "Imre", "Celia", "Patricia", "Jonathan", "민준", "Ünal"]
PARTS = [a + b for a in ("k", "br", "t", "z", "l", "dr", "m", "f", "gor", "p") for b in ("a", "il", "un", "er", "on", "í")]


def names(n, parts=PARTS, seed=5):
    rng = random.Random(seed)
    return [f"{rng.choice(FIRST)} {''.join(rng.choices(parts, k=3)).capitalize()}{rng.choice(['lath', 'xeth', 'rusk'])}" for _ in range(n)]


def brute(nodes, every, top):
    """``(no, id, score)`` in the way of the SQL."""
    low = {}
    for _, i, label in nodes:
        if i is not None and label is not None:
            low[i] = min(low.get(i, label), label)
    tf = {i: Counter(a + b for a, b in zip(x.lower(), x.lower()[1:])) for i, x in low.items()}
    df = Counter(g for c in tf.values() for g in c)
    v = {i: {g: k * (math.log((len(low) + 2) / (df[g] + 1)) + 1) for g, k in c.items()} for i, c in tf.items()}
    norm = {i: math.sqrt(sum(x * x for x in c.values())) for i, c in v.items()}
    out = []
    for no, i, _ in nodes:
        if no % every == 0 and v.get(i):
            scores = [(math.floor(sum(x * c.get(g, 0) for g, x in v[i].items()) / (norm[i] * norm[j]) * 10000 + 0.5) / 10000, j) for j, c in v.items() if j != i and c]
            out += [(no, j, s) for s, j in sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], x[1]))[:top]]
    return sorted(out)


def test_equal_to_every_pair_with_ties_blocks_and_odd_labels(spark):
    labels = names(400) + ["Uwe Talath"] * 30 + ["uwe talath"] * 5 + [None, "", "x", "ab", "😀😀 team", "😀😀", "aaaa"]
    nodes = [(n, f"id{n * 7919 % 1009:04d}", x) for n, x in enumerate(labels)] + [(1000, "id0000", "Zofia"), (1020, None, "Noor"), (1040, "id0000", None)]
    df = spark.createDataFrame(nodes, "node_no long, id string, label string").repartition(5)
    want = brute(nodes, 4, 10)
    for block, chunk in ((16_384, 65_536), (16, 3)):
        got = similar_all(df, every=4, block=block, chunk=chunk)
        assert sorted((r["query_no"], r["id"], round(r["score"], 4)) for r in got.collect()) == want


def test_no_rows_without_labels(spark):
    for nodes in ([], [(20, "a", None)], [(20, "a", "x")]):
        assert similar_all(spark.createDataFrame(nodes, "node_no long, id string, label string")).collect() == []


def test_most_pairs_are_never_multiplied(monkeypatch):
    """Every query met every label before; the bounds leave few of them, and the best ten are those of all pairs."""
    texts = pa.array([x.lower() for x in dict.fromkeys(names(40_000, [a + b + c for a in "bcdfghjklmnpqrstvwz" for b in "aeiouyí" for c in "lmnrstk"]))])
    ids = pa.array([f"{i:05d}" for i in range(len(texts))])
    counted = next(nearest.labels_by_bigram(iter([pa.RecordBatch.from_arrays([texts], ["label"])])))
    w = nearest.weights(counted.column(0).to_numpy(), counted.column(1).to_numpy(), len(texts))
    sizes = []
    dense = nearest.Vectors.dense
    monkeypatch.setattr(nearest.Vectors, "dense", lambda self, entries, *rest: (sizes.append((self.n, len(entries))), dense(self, entries, *rest))[1])
    best = nearest.Nearest(ids[:100], texts[:100], w, 10)
    best.see(ids[:9000], texts[:9000])
    best.see(ids[9000:], texts[9000:])
    done, queries = 0, 0
    for n, k in sizes:
        queries, done = (k, done) if n == 100 else (queries, done + queries * k)
    assert done < 100 * len(texts) / 3
    v = nearest.Vectors(texts, w)
    scores = np.zeros((len(texts), 100))
    m = np.zeros((len(w.codes), 100))
    of = v.rows < 100
    m[v.grams[of], v.rows[of]] = (v.x / v.norms[v.rows])[of]
    np.add.at(scores, v.rows, m[v.grams] * (v.x / v.norms[v.rows])[:, None])
    scores = np.floor(scores.T * 10_000 + 0.5) / 10_000
    np.fill_diagonal(scores, 0)
    want = [(q, -s, i) for q in range(100) for s, i in sorted(zip(-scores[q], range(len(texts))))[:10]]
    assert list(zip(best.q.tolist(), best.score.tolist(), [int(x) for x in best.id.to_pylist()])) == want
