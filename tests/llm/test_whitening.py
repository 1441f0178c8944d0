"""Spectrum slicing and whitened components against numpy's eigenvalues and whole-number arithmetic."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import whitening
from tidemark.llm.common import prepare
from tidemark.llm.whitening import Slicer


def test_counts_are_those_of_the_eigenvalues():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 8, 20):
        a = rng.standard_normal((n, n))
        v = a + a.T
        values = np.linalg.eigvalsh(v)
        slicer = Slicer(v)
        for shift in [*rng.uniform(values[0] - 1, values[-1] + 1, 20), *((values[1:] + values[:-1]) / 2)]:
            assert slicer.above(shift) == whitening.positive_pivots(v - shift * np.eye(n)) == (values > shift).sum()
    hollow = np.array([[0.0, 1, 0], [1, 0, 0], [0, 0, 0]])
    assert Slicer(hollow).above(0.5) == 1 and whitening.positive_pivots(hollow) == 1


@pytest.mark.parametrize("v", [
    np.eye(7), np.diag([3.0, 3, 3, 1, 1]), np.zeros((3, 3)), np.ones((5, 5)), np.array([[2.0]]), np.diag([1.0, 1e-6, 1e-9, 0]),
    np.array([[1.0, 1, 0, 0], [1, 1, 0, 0], [0, 0, 2, 0], [0, 0, 0, 2 - 1e-13]])])
def test_repeated_and_vanishing_eigenvalues(v):
    values, vectors = Slicer(v).leading(4)
    want = np.linalg.eigvalsh(v)[::-1]
    want = want[want > 1e-11 * max(want[0], 1e-300)][:4]
    assert len(values) == len(want)
    np.testing.assert_allclose(values, want, rtol=1e-9)
    np.testing.assert_allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)
    np.testing.assert_allclose(v @ vectors.T, vectors.T * values, atol=1e-12 * max(values, default=1))


def test_small_gaps_keep_their_order():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    v = (q * np.concatenate([[9, 9 - 1e-9, 9 - 2e-9, 8, 7.5], rng.uniform(0, 7, 25)])) @ q.T
    values, vectors = Slicer((v + v.T) / 2).leading(4)
    np.testing.assert_allclose(values, np.linalg.eigvalsh(v)[::-1][:4], rtol=1e-13)
    assert (np.diff(values) < 0).all()


def plain(rows):
    """(id, x) of the rows that count, the fit list, and per row the exact deviation."""
    good = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    return good, fit, [sum((len(fit) * a - s) ** 2 for a, s in zip(x, map(sum, zip(*fit)))) for _, x in good]


def check(found, rows):
    good, fit, deviations = plain(rows)
    x = np.array(fit, dtype=float)
    v = np.cov(x.T, bias=True)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    got = {}
    for r in found:
        got.setdefault(r.vec_id, []).append(r)
    assert sorted(got) == sorted({i for i, _ in good}) and len(found) == len(good) * 4
    sign = {}
    for (i, own), deviation in zip(good, deviations):
        for r in got[i]:
            k = r.component - 1
            want = (np.array(own) - x.mean(axis=0)) @ vectors[:, k] / np.sqrt(values[k])
            assert r.n == len(fit) and r.deviation == deviation and r.identity_error < 1e-9
            assert r.explained == pytest.approx(values[k] / np.trace(v), rel=1e-9)
            if abs(want) > 1e-6:
                assert sign.setdefault(k, np.sign(want) * np.sign(r.whitened)) == np.sign(want) * np.sign(r.whitened)
            assert abs(r.whitened) == pytest.approx(abs(want), rel=1e-7, abs=1e-9)


def test_whitened_vectors(spark):
    prepare(spark)
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    twice = df.unionByName(df.where("vec_id % 3 = 0"))
    rows = [(r.vec_id, r.embedding) for r in twice.collect()]
    assert len({i for i, _ in rows}) == df.count()
    found = whitening.whiten(twice).collect()
    once = {}
    for r in found:
        once.setdefault((r.vec_id, r.component), r)
    check(list(once.values()), list({i: (i, v) for i, v in rows}.values()))
    assert len(found) == 4 * len(rows)


def test_awkward_vectors(spark):
    prepare(spark)
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(0, 1, 6).tolist()) for i in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 0.0]), (103, [float("nan")] + [0.0] * 5), (104, [float("inf")] + [0.0] * 5), (105, [1e300] + [0.0] * 5)]
    other = [(200, [0.5, -0.5]), (201, [0.5, -0.5]), (202, [1.0, 2.0])]
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame(good + bad + other, schema).withColumns({c: F.lit(1) for c in ("x", "n", "value", "size", "component")})
    found = whitening.whiten(df).collect()
    assert {r.vec_id for r in found} == {i for i, _ in good + other}
    check([r for r in found if r.vec_id < 100], good)
    pair = sorted((r for r in found if r.vec_id >= 200), key=lambda r: r.vec_id)
    assert [(r.n, r.component) for r in pair] == [(2, 1)] * 3 and [abs(r.whitened) for r in pair] == pytest.approx([1, 1, 1])
    assert pair[0].explained == pytest.approx(1) and pair[0].deviation == (2 * 128 - 384) ** 2 + (2 * -128 - 384) ** 2
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0  # one point has no spread
    unnamed = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0]), (2, [1.0, 3.0])], schema)).collect()
    assert {r.vec_id for r in unnamed} == {None, 2}


def test_large_entries_stay_exact(spark):
    prepare(spark)
    rows = [(i, [float(2**34 + i), -float(i * i)]) for i in range(50)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    _, _, deviations = plain(rows)
    assert {r.vec_id: r.deviation for r in found} == dict(enumerate(deviations))
    huge = [(i, [float(2**44 - 3 * i), float(i)]) for i in range(3)]
    found = whitening.whiten(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: r.deviation for r in found} == dict(enumerate(plain(huge)[2]))
