import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibrate, evaluate, ridge
from tidemark.plans import slate as SL


@pytest.fixture(scope="module")
def stacked(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3)) * [1.0, 20.0, 0.01] + [5.0, 1000.0, 0.3]
    y = x @ [0.5, 0.02, 30.0] + rng.normal(size=400)
    data = [(i, *(None if i % 9 == 0 and j == 1 else float(v) for j, v in enumerate(r)), 7.0, float(t) if i % 50 else None) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "id long, a double, b double, c double, flat double, runs double").cache()
    return df, x, y


FEATURES = ["a", "b", "c", "flat"]


def test_ridge_equals_the_dense_solution(stacked):
    df, x, y = stacked
    known = np.arange(400) % 50 != 0
    full = np.column_stack([x, np.full(400, 7.0)])
    full[np.arange(400) % 9 == 0, 1] = np.nan
    train, target = full[known].copy(), y[known]
    medians = np.nanmedian(train, axis=0)
    train = np.where(np.isnan(train), medians, train)
    mean, scale = train.mean(axis=0), train.std(axis=0)
    scale[scale == 0] = 1.0
    z = (train - mean) / scale
    want = np.linalg.solve(z.T @ z + 1.5 * np.eye(4), z.T @ (target - target.mean()))
    model = ridge.fit_ridge(df, FEATURES, alpha=1.5)
    got = sorted(model.collect(), key=lambda r: r.position)
    assert [r.coef for r in got] == pytest.approx(list(want), abs=1e-8)
    assert [r.impute for r in got] == pytest.approx(list(medians))
    assert got[0].intercept == pytest.approx(target.mean()) and got[0].train_n == known.sum()
    scored = {r.id: r.runs_pred for r in ridge.score(df, model).collect()}
    row = np.where(np.isnan(full), medians, full)
    assert [scored[i] for i in range(400)] == pytest.approx(list((row - mean) / scale @ want + target.mean()))
    top = ridge.coefficient_table(model).first()
    assert abs(top.coef_std) == pytest.approx(max(abs(want)))


def test_one_gram_serves_many_feature_sets(stacked):
    df, _, _ = stacked
    both = ridge.fit_many(df, {"all": FEATURES, "two": ["a", "c"]})
    alone = {r.feature: r.coef for r in ridge.fit_ridge(df, ["a", "c"]).collect()}
    shared = {r.feature: r.coef for r in both.where("feature_set = 'two'").collect()}
    assert shared == pytest.approx(alone)


def test_model_round_trip(spark, stacked, tmp_path):
    model = ridge.fit_ridge(stacked[0], FEATURES)
    ridge.save_model(model, str(tmp_path / "m"))
    back = ridge.load_model(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, model.collect()))


def games(spark):
    cols = {"home_off_x": 0.3, "away_off_x": 0.2, "home_sp_x": 3.0, "away_sp_x": 4.0}
    df = spark.range(40).withColumnRenamed("id", "game_id").withColumns({c: F.lit(v) + F.col("game_id") % 7 / 10 for c, v in cols.items()})
    return df.withColumns({"home_score": (F.col("game_id") % 7).cast("long"), "away_score": (F.col("game_id") % 4).cast("long"), "season_year": F.lit(2024)})


def test_home_bonus_and_probability(spark):
    model = ridge.train_runs_model(games(spark), ["off_x", "opp_sp_x", "is_home"])
    plain = {r.game_id: r for r in ridge.predict_runs(games(spark), model, 0.0).collect()}
    for r in SL.predict_games(games(spark), model).collect():
        assert r.home_runs_pred == pytest.approx(plain[r.game_id].home_runs_pred + 0.27)
        h, a = r.home_runs_pred ** 1.83, r.away_runs_pred ** 1.83
        assert r.p_home == pytest.approx(h / (h + a))


def test_platt_and_isotonic(spark):
    rng = np.random.default_rng(8)
    p = rng.uniform(0.2, 0.8, 3000)
    y = rng.uniform(size=3000) < 1 / (1 + np.exp(-(4 * p - 1.5)))
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)] + [(None, 1)], "p double, y int")
    fit = calibrate.fit_platt(df, "p", "y")
    r = fit.first()
    design, beta = np.column_stack([np.ones_like(p), p]), np.zeros(2)
    for _ in range(30):  # Newton's method on the same likelihood
        q = 1 / (1 + np.exp(-design @ beta))
        beta += np.linalg.solve(design.T @ (design * (q * (1 - q))[:, None]), design.T @ (y - q))
    assert (r.intercept, r.slope) == pytest.approx(tuple(beta), abs=1e-5) and (r.A, r.B, r.train_n) == (-r.slope, -r.intercept, 3000)
    out = calibrate.apply_platt(df, fit, "p")
    assert out.where("p IS NULL").first().p_calibrated is None
    iso = calibrate.apply_isotonic(df, calibrate.fit_isotonic(df, "p", "y"), "p").where("p IS NOT NULL").orderBy("p").collect()
    values = [x.p_calibrated for x in iso]
    assert all(b >= a - 1e-12 for a, b in zip(values, values[1:]))
    assert sum(values) / len(values) == pytest.approx(y.mean(), abs=1e-6)


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.6), (1, None), (None, 0.4)], "y int, p double")
    m = evaluate.classification_metrics(df, "y", "p").first()
    assert (m.n, m.accuracy, m.home_win_rate) == (2, 0.5, 0.5)
    assert m.log_loss == pytest.approx(-(np.log(0.8) + np.log(0.4)) / 2) and m.brier == pytest.approx((0.04 + 0.36) / 2)
    r = evaluate.regression_metrics(spark.createDataFrame([(3.0, 3.0), (3.0, 4.0)], "a double, p double"), "a", "p").first()
    assert (r.mae, r.bias) == (0.5, 0.5) and r.r2 == pytest.approx(1 - 1 / 1e-9)  # constant target
    h = {x.bin: x.n for x in evaluate.histogram(spark.createDataFrame([(0.0,), (1.0,), (2.0,), (2.5,), (9.0,)], "v double"), "v", 0, 3).collect()}
    assert h == {0.0: 1, 1.0: 1, 2.0: 2}
    assert {r.bin: r.n for r in evaluate.histogram(spark.createDataFrame([(3.0,)], "v double"), "v", 0, 3).collect()} == {2.0: 1}


def plain_isotonic(rows):
    """(low, high, value) of each block, one point at a time."""
    points = {}
    for p, y in rows:
        w, s = points.get(p, (0, 0))
        points[p] = (w + 1, s + y)
    out = []
    for p in sorted(points):
        block = [p, p, *points[p]]
        while out and out[-1][3] / out[-1][2] >= block[3] / block[2] - 1e-15:
            a = out.pop()
            block = [a[0], p, a[2] + block[2], a[3] + block[3]]
        out.append(block)
    return [(a, b, s / w) for a, b, w, s in out]


@pytest.mark.parametrize("shape", ["noisy", "falling", "rising", "steps", "one block over many ranges", "single"])
@pytest.mark.parametrize("ranges,chunk", [(2, 100_000), (9, 40)])
def test_isotonic_blocks_over_borders(spark, shape, ranges, chunk):
    rng = np.random.default_rng(4)
    p = rng.uniform(0, 1, 900)
    y = {"noisy": rng.uniform(size=900) < p, "falling": 1 - p, "rising": p, "steps": np.floor(p * 4) / 4 + rng.normal(0, 0.01, 900),
         "one block over many ranges": np.where(p < 0.05, 5.0, p), "single": p[:1]}[shape]
    rows = [(float(a), float(b)) for a, b in zip(p[:len(y)], y)]
    frame = calibrate.fit_isotonic(spark.createDataFrame(rows, "p double, y double"), "p", "y", ranges, chunk)
    fit = frame.orderBy("low").collect()
    want = plain_isotonic(rows)
    assert [(r.low, r.high) for r in fit] == [w[:2] for w in want]
    assert [r.value for r in fit] == pytest.approx([w[2] for w in want])
    assert [(r.next_low, r.next_value) for r in fit[:-1]] == [(r.low, r.value) for r in fit[1:]] and fit[-1].next_low is None
    asked = spark.createDataFrame([(float(v),) for v in np.linspace(-0.1, 1.1, 200)] + [(None,)], "p double")
    lows, highs, values = (np.array(v) for v in zip(*want))
    curve = np.interp(np.linspace(-0.1, 1.1, 200), np.stack([lows, highs], 1).ravel(), np.repeat(values, 2))
    out = calibrate.apply_isotonic(asked, spark.createDataFrame(fit, frame.schema), "p").orderBy("p").collect()
    assert out[0].p_calibrated is None
    assert [r.p_calibrated for r in out[1:]] == pytest.approx(np.clip(curve, 1e-9, 1 - 1e-9), abs=1e-9)


def test_isotonic_of_nothing(spark):
    fit = calibrate.fit_isotonic(spark.createDataFrame([(None, 1.0)], "p double, y double"), "p", "y")
    assert fit.count() == 0
    out = calibrate.apply_isotonic(spark.createDataFrame([(0.5,), (None,)], "p double"), fit, "p").collect()
    assert {r.p_calibrated for r in out} == {None}


def test_platt_without_spread_or_rows(spark):
    one = calibrate.fit_platt(spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 1), (0.5, 1)], "p double, y int"), "p", "y").first()
    assert 1 / (1 + np.exp(-(one.slope * 0.5 + one.intercept))) == pytest.approx(0.75)
    none = calibrate.fit_platt(spark.createDataFrame([(None, 1)], "p double, y int"), "p", "y").first()
    assert (none.slope, none.intercept, none.train_n, none.train_p_mean) == (0.0, 0.0, 0, None)


def test_windows_are_fits_of_their_seasons(spark):
    """Keyed Gram matrices give what a fit of each window's rows gives, with the window's own medians."""
    rng = np.random.default_rng(6)
    rows = [(2000 + i % 4, None if rng.random() < 0.2 + 0.1 * (i % 4) else float(rng.normal(i % 4, 1)), float(rng.normal()), float(rng.normal(3, 1)) if i % 17 else None)
            for i in range(800)]
    df = spark.createDataFrame(rows, "season_year int, a double, b double, runs double")
    sets = {"both": ["a", "b"], "one": ["b"]}
    got = {(r.through, r.feature_set, r.feature): r for r in ridge.fit_windows(df, sets).collect()}
    assert len(got) == 12
    for through in range(2000, 2004):
        for r in ridge.fit_many(df.where(F.col("season_year") <= through), sets).collect():
            w = got[through, r.feature_set, r.feature]
            assert w.train_n == r.train_n
            for c in ("impute", "mean", "scale", "coef", "intercept", "target_std"):
                assert getattr(w, c) == pytest.approx(getattr(r, c), rel=1e-9, abs=1e-12)
    scored = ridge.score_models(df.limit(5), ridge.fit_windows(df, sets))
    assert scored.count() == 5 * 8
