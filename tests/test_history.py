import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, counts, history, rows
from tidemark.operators.composites import lineup_composite
from tidemark.schemas import EVENTS, align


def pitch(game, date, batter, event, bb=None, value=0.0, estimate=None, pitcher=1, barrel=None):
    d = dt.date.fromisoformat(date)
    return (game, d, d.year, pitcher, batter, event, bb, value, 1.0, estimate, barrel)


COLS = ("game_pk long, game_date date, game_year int, pitcher long, batter long, events string, bb_type string, woba_value double, "
        "woba_denom double, estimated_woba_using_speedangle double, launch_speed_angle int")


@pytest.fixture(scope="module")
def pitches(spark):
    data = [
        pitch(1, "2024-04-01", 7, "single", "ground_ball", 0.9, 0.4),
        pitch(1, "2024-04-01", 7, "strikeout"),
        pitch(1, "2024-04-01", 7, None),
        pitch(1, "2024-04-01", 7, "pickoff_1b"),
        pitch(2, "2024-04-01", 7, "home_run", "fly_ball", 2.0, None, barrel=6),
        pitch(3, "2024-04-30", 7, "walk", None, 0.7),
        pitch(4, "2024-05-01", 7, "field_out", "line_drive", None, None),
        pitch(5, "2025-04-02", 7, "double", "line_drive", 1.25, 0.8),
        pitch(6, "2024-04-10", 8, "walk", None, 0.7),
        pitch(6, "2024-04-10", None, "walk", None, 0.7),
    ]
    return align(spark.createDataFrame(data, COLS), EVENTS)


def row(df, **where):
    for k, v in where.items():
        df = df.where(F.col(k) == (F.lit(v).cast("date") if k == "game_date" else v))
    got = df.collect()
    assert len(got) == 1
    return got[0]


def test_daily_counts_and_contact_numerator(pitches):
    daily = counts.daily_counts(pitches, "batter")
    first = row(daily, player_id=7, game_date="2024-04-01")
    assert (first.PA, first.SO, first._1B, first.HR, first.GB, first.FB, first.BBE, first.BARREL) == (3, 1, 1, 1, 1, 1, 2, 1)
    # Estimate on contact (0.4), realised value where it is missing (2.0).
    assert first.XWOBA_NUM == pytest.approx(2.4)
    # Contact without estimate or value adds nothing, and an all-missing group is 0.
    assert row(daily, player_id=7, game_date="2024-05-01").XWOBA_NUM == 0.0
    assert daily.where("player_id IS NULL").count() == 0


def test_running_totals_reset_each_season(pitches):
    idx = history.season_index(pitches, "batter")
    assert row(idx, player_id=7, game_date="2024-05-01").PA_cum == 5
    assert row(idx, player_id=7, game_date="2025-04-02").PA_cum == 1


def test_trailing_window_keeps_day_29_and_drops_day_30(pitches):
    idx = history.trailing_index(pitches, "batter", 30)
    assert row(idx, player_id=7, game_date="2024-04-30").PA_cum == 4   # 29 days back: inside
    assert row(idx, player_id=7, game_date="2024-05-01").PA_cum == 2   # 30 days back: outside


def test_joint_index_equals_the_separate_ones(pitches):
    joint = history.joint_index(pitches, "batter")
    season, trailing = history.season_index(pitches, "batter"), history.trailing_index(pitches, "batter")
    a = joint.select("player_id", "game_date", "PA_cum", "xwOBA", "PA_cum_30d", "xwOBA_30d")
    b = season.select("player_id", "game_date", "PA_cum", "xwOBA").join(
        trailing.select("player_id", "game_date", F.col("PA_cum").alias("PA_cum_30d"), F.col("xwOBA").alias("xwOBA_30d")), ["player_id", "game_date"])
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def games(spark, *data):
    return spark.createDataFrame(data, "game_id long, starter long, game_date string").withColumn("game_date", F.to_date("game_date"))


def test_asof_is_strict_and_season_bound(spark, pitches):
    idx = history.season_index(pitches, "batter")
    g = games(spark, (1, 7, "2024-04-01"), (2, 7, "2024-04-02"), (3, 7, "2025-04-02"), (4, None, "2024-05-01"), (5, 99, "2024-05-01"), (6, 7, "2024-04-02"))
    got = {r.game_id: r.x_PA_cum for r in asof.asof_join(g, idx, by="starter", features=["PA_cum"], prefix="x_").collect()}
    assert got == {1: None, 2: 3, 3: None, 4: None, 5: None, 6: 3}
    wide = {r.game_id: r.PA_cum for r in asof.asof_join(g, idx, by="starter", features=["PA_cum"], same_season=False).collect()}
    assert wide[3] == 5
    with pytest.raises(KeyError):
        asof.asof_join(g, idx, by="starter", features=["nope"])


def test_asof_lookup(pitches):
    idx = history.season_index(pitches, "batter")
    assert asof.asof_lookup(idx, 7, "2024-04-30").first().PA_cum == 3
    assert asof.asof_lookup(idx, 7, "2025-01-01").count() == 0
    assert asof.asof_lookup(idx, 7, "2025-01-01", same_season=False).first().PA_cum == 5


def test_no_lookahead(spark):
    """Changing anything on or after a date leaves the features at that date alone."""
    rng = random.Random(5)
    days = [dt.date(2024, 4, 1) + dt.timedelta(days=i) for i in range(40)]
    base = [pitch(i, rng.choice(days).isoformat(), rng.randint(1, 3), rng.choice(["single", "walk", "strikeout", "home_run"]), None, rng.random()) for i in range(300)]
    cut = dt.date(2024, 4, 20)
    changed = [p if p[1] < cut else (*p[:5], "walk", *p[6:]) for p in base] + [pitch(999, cut.isoformat(), 1, "single", None, 0.9)]
    g = games(spark, *[(i, i, cut.isoformat()) for i in (1, 2, 3)])
    results = []
    for data in (base, changed):
        idx = history.joint_index(align(spark.createDataFrame(data, COLS), EVENTS), "batter")
        out = asof.asof_join(g, idx, by="starter", features=["PA_cum", "wOBA", "SIERA", "PA_cum_30d", "wOBA_30d"])
        results.append(sorted((tuple(r) for r in out.collect()), key=lambda r: r[0]))
    assert [r[:3] for r in results[0]] == [r[:3] for r in results[1]]
    for a, b in zip(*results):
        assert a[3:] == pytest.approx(b[3:])


def test_composite_of_a_constant_and_missing_slots(spark):
    long = spark.createDataFrame([(1, "home", s, 0.3 if s != 4 else None, 9.0) for s in range(1, 12)] + [(2, "home", 3, None, 1.0)],
                                 "game_id long, side string, slot int, v double, w double")
    got = {r.game_id: r for r in lineup_composite(long, ["v", "w"]).collect()}
    assert got[1].v == pytest.approx(0.3) and got[1].w == pytest.approx(9.0)
    assert got[2].v is None and got[2].w == pytest.approx(1.0)


def test_sample_floor_keeps_the_sample(spark):
    df = spark.createDataFrame([(10, 0.5), (30, 0.5), (None, 0.5)], "PA_cum int, K_pct double")
    got = rows.sample_floor(df, ["K_pct", "PA_cum"], "PA_cum", 25).collect()
    assert [(r.PA_cum, r.K_pct) for r in got] == [(10, None), (30, 0.5), (None, None)]


def test_modal_value_ties_take_the_smallest(spark):
    df = spark.createDataFrame([(1, "R"), (1, "L"), (2, "R"), (2, "R"), (2, None), (3, None)], "batter int, stand string")
    assert {r.batter: r.stand for r in counts.modal_value(df, ["batter"], "stand").collect()} == {1: "L", 2: "R"}
