import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import scan


@pytest.fixture(scope="module")
def walk(spark):
    rng = random.Random(3)
    # One instant holds a third of the rows, one group two thirds of them.
    data = [("big" if i % 3 else "small", 100 if i % 3 == 1 else rng.randint(0, 200), i, rng.uniform(-0.05, 0.06)) for i in range(3000)]
    return data, spark.createDataFrame(data, "g string, t int, id long, x double").withColumn("f", 1 + F.col("x")).cache()


@pytest.mark.parametrize("partition", [[], ["g"]])
@pytest.mark.parametrize("ranges", [5, 70])
def test_running_equals_a_sequential_fold(walk, partition, ranges):
    data, df = walk
    ranged = scan.with_ranges(df, [*partition, "t", "id"], ranges)
    assert ranged.select(scan.BUCKET).distinct().count() > 1
    out = scan.running(ranged, {"s": ("sum", "x"), "p": ("product", "f"), "m": ("max", "x"), "before": ("product", "f")},
                       ["t", "id"], partition, exclusive=["before"])
    got = {r.id: (r.s, r.p, r.m, r.before) for r in out.collect()}
    assert len(got) == len(data)
    groups = {}
    for g, t, i, x in sorted(data, key=lambda r: (r[1], r[2])):
        s, p, m = groups.get(g if partition else "", (0.0, 1.0, -9.0))
        new = (s + x, p * (1 + x), max(m, x))
        groups[g if partition else ""] = new
        assert got[i] == pytest.approx((*new, p))


def test_ranges_never_go_back(walk):
    _, df = walk
    rows = scan.with_ranges(df, ["t", "id"], 40).orderBy("t", "id").select(scan.BUCKET).collect()
    numbers = [r[0] for r in rows]
    assert numbers == sorted(numbers)
    biggest = max(numbers.count(n) for n in set(numbers))
    assert biggest < len(numbers) / 5  # the crowded instant is split by its tie-break


def test_exact_quantiles_match_numpy(spark):
    rng = random.Random(9)
    values = {"a": [rng.gauss(0, 1) for _ in range(1500)], "b": [float(rng.randint(0, 4)) for _ in range(900)], "c": [2.5]}
    long = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("a", None)], "key string, value double")
    probs = [0.0, 0.1, 0.5, 0.8, 1.0]
    got = {r.key: (r.n, r.q) for r in scan.exact_quantiles(long, probs).collect()}
    for k, vs in values.items():
        assert got[k][0] == len(vs)
        assert got[k][1] == pytest.approx(list(np.quantile(vs, probs)))


def test_quantile_bucket_drops_repeated_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [1] * 50 + list(range(2, 12))], "x double")
    got = {r.bucket: r["count"] for r in scan.quantile_bucket(df, "x", 10).groupBy("bucket").count().collect()}
    # Edges: nine of eleven are 1.0 apart from the top ones; everything equal to 1 shares the lowest bucket.
    edges = np.unique(np.quantile([1] * 50 + list(range(2, 12)), np.linspace(0, 1, 11)))
    want = {}
    for v in [1] * 50 + list(range(2, 12)):
        b = max(int((edges < v).sum()) - 1, 0)
        want[b] = want.get(b, 0) + 1
    assert got == want


def test_ranges_follow_the_width_without_a_limit(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"))
    for ranges in (2, 40, 1500):
        got = scan.with_ranges(df, ["v"], ranges).groupBy(scan.BUCKET).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n")).orderBy(scan.BUCKET).collect()
        assert len(got) > 0.9 * ranges and max(r.n for r in got) < 6 * 5000 / ranges
        assert all(a.high < b.low for a, b in zip(got, got[1:]))
    few = spark.range(3).select(F.col("id").alias("v"))
    assert scan.with_ranges(few, ["v"], 50).select(scan.BUCKET).distinct().count() == 3
    assert scan.with_ranges(few.limit(0), ["v"], 50).count() == 0


def test_plans_hold_no_edges(spark):
    """What a plan says does not grow with the number of ranges, and results stay right at 2,000 of them."""
    df = spark.range(4000).select((F.col("id") * 7919 % 4000).cast("double").alias("v"), F.col("id"), F.lit(1).alias("one"))
    size = {}
    for ranges in (4, 2000):
        cut = scan.with_ranges(df, ["v", "id"], ranges)
        size[ranges] = len(cut._jdf.queryExecution().optimizedPlan().toString())
        out = scan.running(cut, {"n": ("sum", "one")}, ["v", "id"])
        assert out.where(F.col("n") != F.col("v") + 1).count() == 0 and out.count() == 4000
    assert abs(size[2000] - size[4]) < 10
