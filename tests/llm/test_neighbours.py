"""Neighbour search against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import neighbours
from tidemark.llm.common import prepare

def asks():
    return F.col("vec_id") % 20 == 0


def brute(ids, x, k=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort([ids, -score]) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def recall(spark, table, settings=neighbours.Settings()):
    rows = table.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    want = brute(ids, x)
    got = {}
    for r in neighbours.nearest(table, asks(), settings=settings).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert len(found) == len(want[q]) and [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        exact = (x * x[np.flatnonzero(ids == q)[0]]).sum(axis=1)
        where = {int(i): j for j, i in enumerate(ids)}
        assert all(s == exact[where[v]] for v, s in found)
    return np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / len(want[q]) for q in want])


def test_recall_on_the_given_vectors(spark):
    table = prepare(spark).read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert recall(spark, table) >= 0.95
    assert recall(spark, table, neighbours.Settings(block=300, query_block=40)) >= 0.95


def test_recall_with_unequal_norms(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 24)) * rng.lognormal(0, 0.7, (3000, 1))
    assert recall(spark, spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")) >= 0.9


def test_many_copies_tie_by_id(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(400, 8)), 3)
    x[100:300] = x[0]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(table, F.col("vec_id") == 0, settings=neighbours.Settings(block=64)).orderBy("rank").collect()
    best = [r.vec_id for r in got if r.score == got[-1].score]
    assert best == sorted(best) and {100, 101} <= {r.vec_id for r in got}


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]),
            (7, [3.0, 1.0]), (7, [3.0, 1.0]), (8, [1.0, 2.0, 3.0]), (40, [5.0, 5.0, 5.0]), (60, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({n: F.lit(1) for n in ("id", "v", "dim", "block", "score", "rank", "largest", "ask_id")})
    got = [tuple(r) for r in neighbours.nearest(table, asks()).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7, 3.0), (0, 2, 20, 0.0), (20, 1, 7, 2.0), (20, 2, 0, 0.0), (40, 1, 8, 30.0)]
    assert neighbours.nearest(table.limit(0), asks()).count() == 0
