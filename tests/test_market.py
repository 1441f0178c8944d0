import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bets, ledger, odds

QUOTE = ("snapshot_ts string, commence_time string, home_team string, away_team string, book_key string, book_title string, "
         "home_price_american double, away_price_american double")


def quotes(spark, *rows):
    df = spark.createDataFrame([(f"2024-05-01 {t}:00", f"2024-05-01 {c}:00", h, "Away", b, b.upper(), x, y) for t, c, h, b, x, y in rows], QUOTE)
    return df.withColumns({c: F.to_timestamp(c) for c in ("snapshot_ts", "commence_time")})


def test_best_lines_traps(spark):
    q = quotes(
        spark,
        ("10:00", "19:00", "A", "draftkings", 120.0, -140.0), ("18:00", "19:00", "A", "fanduel", 130.0, -150.0),
        ("18:00", "19:00", "A", "betmgm", 130.0, -145.0), ("18:45", "19:00", "A", "fanduel", 400.0, -480.0),   # after the cutoff
        ("18:00", "19:00", "A", "elsewhere", 190.0, 150.0),                                                     # book not allowed
        ("10:00", "19:00", "B", "fanduel", 110.0, -130.0), ("18:00", "19:00", "B", "fanduel", 900.0, -2000.0),  # latest is extreme: dropped
        ("18:50", "19:00", "C", "fanduel", 110.0, -130.0),                                                      # nothing before the cutoff
    )
    got = odds.best_lines(q).collect()
    assert [r.home_team for r in got] == ["A"]
    a = got[0]
    assert (a.home_price_american, a.away_price_american, a.home_book, a.away_book, a.n_books) == (130.0, -145.0, "BETMGM", "BETMGM", 2)
    assert a.snapshot_ts == dt.datetime(2024, 5, 1, 18, 0)
    kept = odds.best_lines(q, drop_extreme=False, minutes=0).where("home_team = 'B'").first()
    assert kept.home_price_american == 900.0
    assert odds.best_lines(q, strategy="median").first().away_price_american == -147.5
    assert odds.best_lines(q.where("false")).count() == 0
    with pytest.raises(ValueError):
        odds.best_lines(q, strategy="worst")


def slate(spark, rows):
    """rows: (game, minute, p, home price, away price, home score, away score)"""
    df = spark.createDataFrame(
        [(g, dt.date(2024, 5, 1), dt.datetime(2024, 5, 1, 12, m), p, x, y, hs, as_) for g, m, p, x, y, hs, as_ in rows],
        "game_id long, game_date date, commence_time timestamp, p_home double, home_price_american double, away_price_american double, home_score long, away_score long")
    return df.withColumns({"home_id": F.lit(1), "away_id": F.lit(2), "home_name": F.lit("H"), "away_name": F.lit("A"), "home_book": F.lit("hb"),
                           "away_book": F.lit("ab"), "snapshot_ts": F.col("commence_time") - F.expr("INTERVAL 1 HOUR")})


ROWS = [(1, 0, 0.52, 110.0, -130.0, 5, 3), (2, 5, 0.5, 100.0, 100.0, 1, 0), (3, 5, 0.50, -110.0, 105.0, 2, 4), (4, 9, 0.9, 150.0, -170.0, 1, 9),
        (5, 11, 0.49, 108.0, -120.0, 3, 3), (6, 12, 0.51, 108.0, -120.0, None, None), (7, 13, 0.53, 105.0, -125.0, 1, 2)]


def test_recommendation_rules(spark):
    out = {r.game_id: r for r in bets.annotate_bets(slate(spark, ROWS)).collect()}
    assert out[2].recommended == "" and out[2].ev_home == out[2].ev_away == 0.0     # ties recommend nothing
    assert out[4].recommended == ""                                                   # edge beyond the cap
    assert out[1].recommended == "home" and out[3].recommended == "away"
    assert out[2].risk_units is None and out[2].recommended_kelly == 0.0
    chosen = [r for r in out.values() if r.recommended]
    mean = sum(r.recommended_kelly_pre_daily for r in chosen) / len(chosen)
    assert all(r.risk_ref_kelly == pytest.approx(mean) for r in chosen)


def test_daily_cap_scales_stakes_but_not_units(spark):
    free = {r.game_id: r for r in bets.annotate_bets(slate(spark, ROWS), daily_cap=None).collect()}
    tight = {r.game_id: r for r in bets.annotate_bets(slate(spark, ROWS), daily_cap=0.001, slate_keys=["game_date"]).collect()}
    assert sum(r.recommended_kelly for r in tight.values()) == pytest.approx(0.001)
    assert all(free[g].risk_units == tight[g].risk_units for g in free)
    assert free[1].daily_stake_scaled is None and tight[1].daily_stake_scaled is True


def test_bankroll_is_a_sequential_fold(spark):
    s = bets.annotate_bets(slate(spark, ROWS), multiplier=1.0, cap=0.2, daily_cap=None, max_edge=None)
    history = bets.simulate_bankroll(s).orderBy("bet_idx").collect()
    bank, peak = 100.0, 100.0
    rows = [r for r in s.orderBy("commence_time", "game_id").collect() if r.recommended and r.home_score is not None]
    assert [h.game_id for h in history] == [r.game_id for r in rows]
    for h, r in zip(history, rows):
        dec = r.home_decimal if r.recommended == "home" else r.away_decimal
        won = (r.home_score > r.away_score) == (r.recommended == "home")
        stake = bank * r.recommended_kelly
        profit = 0.0 if r.home_score == r.away_score else stake * (dec - 1) if won else -stake
        bank += profit
        peak = max(peak, bank)
        assert (h.stake, h.profit, h.bankroll_after, h.drawdown) == pytest.approx((stake, profit, bank, (peak - bank) / peak))
    summary = bets.backtest_summary(bets.simulate_bankroll(s)).first()
    assert summary.final_bankroll == pytest.approx(bank) and summary.n_bets == len(rows)
    assert summary.n_losses + summary.n_wins == sum(r.home_score != r.away_score for r in rows)
    empty = bets.backtest_summary(bets.simulate_bankroll(s.where("false"))).first()
    assert (empty.n_bets, empty.final_bankroll) == (0, 100.0)


def test_sweep_has_every_scenario(spark):
    s = bets.price_columns(slate(spark, ROWS))
    got = {(r.ev_threshold, r.max_edge): r.n_bets for r in bets.threshold_sweep(s, thresholds=(0.0, 5.0), max_edges=(None, 0.07)).collect()}
    assert set(got) == {(0.0, float("inf")), (5.0, float("inf")), (0.0, 0.07), (5.0, 0.07)}
    assert got[(5.0, 0.07)] == 0 and got[(0.0, float("inf"))] > got[(0.0, 0.07)] > 0


def test_ledger_life_cycle(spark):
    s = bets.annotate_bets(slate(spark, ROWS))
    first = ledger.merge_recommendations(ledger.normalise(spark.createDataFrame([], "game_id long")), s, "2024-05-01 11:00:00")
    assert {r.action for r in first.collect()} == {"inserted"}
    log = first.drop("action")
    again = ledger.merge_recommendations(log, s, "2024-05-01 11:30:00")
    assert {r.action for r in again.collect()} == {"skipped_paper_locked"}
    assert again.drop("action").exceptAll(log).count() == 0
    # The started-game check comes before the committed-pick check.
    late = ledger.ledger_counts(ledger.merge_recommendations(log, s, "2024-05-02 00:00:00")).first()
    assert (late.skipped_post_commence, late.skipped_paper_locked, late.inserted) == (log.count(), 0, 0)
    legacy = log.withColumn("recommended_side", F.lit(None).cast("string")).withColumn("closing_odds", F.lit(111.0))
    updated = ledger.merge_recommendations(legacy, s, "2024-05-01 11:00:00").collect()
    assert {r.action for r in updated} == {"updated"} and {r.closing_odds for r in updated} == {111.0}

    scores = ledger.final_scores(s.withColumn("season_year", F.lit(2024)).select("game_id", "home_score", "away_score", "season_year"))
    settled = ledger.reconcile_outcomes(log, scores)
    twice = ledger.reconcile_outcomes(settled, scores)
    assert settled.exceptAll(twice).count() == 0
    by_game = {r.game_id: r for r in settled.collect()}
    assert by_game[1].outcome == "won" and by_game[1].profit_units == pytest.approx(by_game[1].risk_units * 1.1)
    total = ledger.ledger_summary(settled).first()
    assert total.n_settled + total.n_pending == total.n_bets == log.count()


def test_canonical_season_wins_over_fallback(spark):
    cols = "game_id long, home_score long, away_score long, season_year int"
    canonical = spark.createDataFrame([(1, 5, 4, 2023)], cols)
    fallback = spark.createDataFrame([(1, 0, 9, 2023), (2, 1, 0, 2023), (3, 7, 2, 2024), (4, None, 2, 2024)], cols)
    got = {r.game_id: r.home_score for r in ledger.final_scores(canonical, fallback).collect()}
    assert got == {1: 5.0, 3: 7.0}


def test_slate_join_keeps_the_later_start(spark):
    lines = spark.createDataFrame([("2024-05-02 01:00:00", 1, 2, 110.0, -130.0), ("2024-05-01 17:00:00", 1, 2, 120.0, -140.0)],
                                  "commence_time string, home_id long, away_id long, home_price_american double, away_price_american double")
    lines = lines.withColumn("commence_time", F.to_timestamp("commence_time"))
    games = spark.createDataFrame([(9, dt.date(2024, 5, 1), 1, 2), (10, dt.date(2024, 5, 1), 3, 4)], "game_id long, game_date date, home_id long, away_id long")
    assert [(r.game_id, r.home_price_american) for r in odds.join_slate(games, lines).collect()] == [(9, 110.0)]
    assert {r.game_id: r.home_price_american for r in odds.join_slate(games, lines, require_odds=False).collect()} == {9: 110.0, 10: None}
