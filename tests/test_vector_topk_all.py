"""Neighbours of every twentieth vector against all pairs."""

import math
import random

from loam.operators.reports import vector_topk_all


def test_all_queries_against_all_vectors(spark):
    random.seed(4)
    rows = [(i, [random.uniform(-1, 1) for _ in range(5)]) for i in range(3000)]
    rows[40] = (40, [0.0] * 5)
    rows[60] = (60, None)
    rows[7] = (7, [1.0, 2.0])
    rows.append((None, [1.0] * 5))

    def score(a, b):
        if b is None or len(a) != len(b):
            return 0.0
        norm = math.dist(a, [0] * 5) * math.dist(b, [0] * 5)
        return sum(x * y for x, y in zip(a, b)) / norm if norm else 0.0

    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in vector_topk_all(df).collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert sorted(got) == [i for i in range(0, 3000, 20) if i != 60]
    for q, found in got.items():
        want = sorted((-score(rows[q][1], v), i) for i, v in rows if i is not None)[:10]
        assert [i for _, i in sorted(found)] == [i for _, i in want] and all(math.isclose(a, b, abs_tol=1e-12) for (a, _), (b, _) in zip(sorted(found), want))
