"""Decisions on a slate, bankroll replay and threshold sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark import constants as K
from tidemark.functions import pricing as P
from tidemark.operators import scan

_SCENARIO = ["ev_threshold", "max_edge"]


def _pick(threshold: Column | float, max_edge: Column | float | None) -> Column:
    """Side with the strictly higher expected value, above the threshold, inside the edge cap."""
    home, away = F.col("ev_home"), F.col("ev_away")
    take_home, take_away = (home > away) & (home > threshold), (away > home) & (away > threshold)
    if max_edge is not None:
        take_home = take_home & (F.abs("edge_home") <= max_edge)
        take_away = take_away & (F.abs("edge_away") <= max_edge)
    return F.when(take_home, "home").when(take_away, "away").otherwise("")


def _by_side(side: Column, home: Column, away: Column, none=0.0) -> Column:
    return F.when(side == "home", home).when(side == "away", away).otherwise(F.lit(none))


def price_columns(df: DataFrame, *, model_p: str = "p_home", home_price: str = "home_price_american",
                  away_price: str = "away_price_american", multiplier: float = K.KELLY_MULTIPLIER,
                  cap: float | None = K.KELLY_CAP, vig_method: str = "proportional") -> DataFrame:
    """Decimal odds, implied and fair probabilities, edges, EV and Kelly of both sides."""
    df = df.withColumns({"home_decimal": P.american_to_decimal(F.col(home_price).cast("double")),
                         "away_decimal": P.american_to_decimal(F.col(away_price).cast("double"))})
    df = df.withColumns({"home_implied": P.decimal_to_implied(F.col("home_decimal")),
                         "away_implied": P.decimal_to_implied(F.col("away_decimal"))})
    fair_home, fair_away = P.remove_vig(F.col("home_implied"), F.col("away_implied"), vig_method)
    df = df.withColumns({"vig": P.vig_pct(F.col("home_implied"), F.col("away_implied")),
                         "home_fair_p": fair_home, "away_fair_p": fair_away})
    p = F.col(model_p)
    return df.withColumns({
        "edge_home": p - F.col("home_fair_p"), "edge_away": (1.0 - p) - F.col("away_fair_p"),
        "ev_home": P.expected_value(p, F.col("home_decimal")),
        "ev_away": P.expected_value(1.0 - p, F.col("away_decimal")),
        "kelly_home": P.kelly_fraction(p, F.col("home_decimal"), multiplier, cap),
        "kelly_away": P.kelly_fraction(1.0 - p, F.col("away_decimal"), multiplier, cap),
    })


def annotate_bets(df: DataFrame, *, ev_threshold: float = 0.0, max_edge: float | None = K.MAX_EDGE,
                  multiplier: float = K.KELLY_MULTIPLIER, cap: float | None = K.KELLY_CAP,
                  daily_cap: float | None = K.DAILY_STAKE_CAP, vig_method: str = "proportional",
                  slate_keys: Sequence[str] = (), **columns) -> DataFrame:
    """Price both sides, recommend at most one, and size it against its slate.

    A slate is the whole frame (``slate_keys=()``) or one value of ``slate_keys``,
    e.g. ``["game_date"]`` when many days are scored together. Slate totals are
    small aggregates joined back, never a window over the slate.
    """
    df = price_columns(df, multiplier=multiplier, cap=cap, vig_method=vig_method, **columns)
    df = df.withColumn("recommended", _pick(ev_threshold, max_edge))
    side = F.col("recommended")
    df = df.withColumns({
        "recommended_ev": _by_side(side, F.col("ev_home"), F.col("ev_away")),
        "recommended_kelly_pre_daily": _by_side(side, F.col("kelly_home"), F.col("kelly_away")),
    })
    stake, chosen = F.col("recommended_kelly_pre_daily"), F.col("recommended") != ""
    totals = [F.avg(F.when(chosen, stake)).alias("_mean"), F.sum(stake).alias("_total")]
    if slate_keys:
        df = df.join(df.groupBy(*slate_keys).agg(*totals), list(slate_keys), "left")
    else:
        slate = df.agg(*totals)
        df = df.withColumns({"_mean": slate.select("_mean").scalar(), "_total": slate.select("_total").scalar()})
    ref = F.when(F.col("_mean") > 0, F.col("_mean")).otherwise(F.lit(P.kelly_reference_fallback(cap, multiplier)))
    df = df.withColumns({
        "risk_ref_kelly": F.when(chosen, ref),
        "risk_units": F.when(chosen, P.kelly_to_units(stake, ref, cap)),
    })
    if daily_cap is not None and daily_cap > 0:
        over = F.coalesce(F.col("_total") > daily_cap, F.lit(False))
        scale = F.when(over, daily_cap / F.col("_total")).otherwise(F.lit(1.0))
        df = df.withColumns({"daily_stake_scaled": over, "daily_stake_scale_factor": scale})
        df = df.withColumn("recommended_kelly", stake * F.col("daily_stake_scale_factor"))
    else:
        df = df.withColumns({"daily_stake_scaled": F.lit(None).cast("boolean"),
                             "daily_stake_scale_factor": F.lit(None).cast("double"), "recommended_kelly": stake})
    return df.drop("_mean", "_total")


def settled_bets(slate: DataFrame, min_kelly: float = 0.0) -> DataFrame:
    """Recommended bets with known scores, and each one's return per unit of bankroll."""
    side = F.col("recommended")
    bets = slate.where(
        side.isin("home", "away") & (F.col("recommended_kelly") >= min_kelly)
        & F.col("home_score").isNotNull() & F.col("away_score").isNotNull()
    )
    bets = bets.withColumns({
        "decimal_odds": P.american_to_decimal(_by_side(side, F.col("home_price_american"), F.col("away_price_american")).cast("double")),
        "_outcome": P.outcome_of(side, F.col("home_score"), F.col("away_score")),
        "kelly": F.col("recommended_kelly"),
    })
    return bets.withColumns({
        "_step": F.coalesce(P.settle_profit(F.col("_outcome"), F.col("decimal_odds"), F.col("kelly")), F.lit(0.0)),
        "won": F.when(F.col("_outcome") == "won", True).when(F.col("_outcome") == "lost", False),
    })


def simulate_bankroll(slate: DataFrame, *, start: float = 100.0, min_kelly: float = 0.0,
                      order: Sequence[str] = ("commence_time", "game_id"), scenario: Sequence[str] = ()) -> DataFrame:
    """Per-bet history of a chronologically compounded bankroll.

    The bankroll after a bet is ``start * prod(1 + kelly * return)`` over the bets
    so far, so it is a running product, and its peak a running maximum; both come
    from one ranged scan. ``order`` needs a unique tie-break.
    """
    order, scenario = list(order), list(scenario)
    bets = settled_bets(slate, min_kelly).withColumn("_growth", 1.0 + F.col("_step"))
    cells = [*scenario, scan.BUCKET]
    inside = W.partitionBy(*cells).orderBy(*order)
    upto, before = inside.rowsBetween(W.unboundedPreceding, W.currentRow), inside.rowsBetween(W.unboundedPreceding, -1)
    local = scan.with_ranges(bets, [*scenario, *order]).withColumns({
        "_b": F.product("_growth").over(upto), "_before": F.coalesce(F.product("_growth").over(before), F.lit(1.0)), "_n": F.row_number().over(inside)})
    local = local.withColumns({"_top": F.max("_b").over(upto), "_low": F.min("_b").over(upto)})
    # One row per range: its growth, and the highest and lowest point on the way, are enough to carry product and peak on.
    totals = local.groupBy(*cells).agg(F.product("_growth").alias("_g"), F.max("_b").alias("_t"), F.min("_b").alias("_l"), F.count(F.lit(1)).alias("_m"))
    earlier = W.partitionBy(*scenario).orderBy(scan.BUCKET).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumns({"_c": F.coalesce(F.product("_g").over(earlier), F.lit(1.0)), "_k": F.coalesce(F.sum("_m").over(earlier), F.lit(0))})

    def highest(top: str, low: str):  # a stake above the bankroll may turn its sign
        return F.greatest(F.col("_c") * F.col(top), F.col("_c") * F.col(low))

    carries = totals.select(*cells, "_c", "_k", F.max(highest("_t", "_l")).over(earlier).alias("_p"))
    grown = local.join(carries, cells).withColumn("bankroll_after", start * F.col("_c") * F.col("_b"))
    before_bet = start * F.col("_c") * F.col("_before")
    peak = F.greatest(F.lit(float(start)), start * F.col("_p"), start * highest("_top", "_low"))
    out = grown.withColumns({
        "bet_idx": F.col("_k") + F.col("_n") - 1, "stake": before_bet * F.col("kelly"), "profit": before_bet * F.col("_step"), "peak": peak,
        "drawdown": F.when(peak > 0, (peak - F.col("bankroll_after")) / peak).otherwise(F.lit(0.0)),
        "ev_at_bet": F.col("recommended_ev"), "growth": F.col("_growth"),
    })
    drop = ["_growth", "_b", "_before", "_n", "_top", "_low", "_c", "_k", "_p", "_step", "_outcome", scan.BUCKET]
    return out.withColumnRenamed("recommended", "side").drop(*drop)


def backtest_summary(history: DataFrame, *, start: float = 100.0, scenario: Sequence[str] = ()) -> DataFrame:
    """The fifteen back-test statistics, one row per scenario, and ``log_growth``.

    ``log_growth`` is a sum of logarithms, as the product of all bets leaves the range of a double after some hundred thousand; the columns
    that hold a bankroll are infinite then. It is NULL if a bet lost the whole bankroll.
    """
    n, wins = F.count(F.lit(1)), F.count_if("won")
    decided = F.count("won")
    final = F.coalesce(F.max_by("bankroll_after", "bet_idx"), F.lit(float(start)))
    wagered, profit = F.coalesce(F.sum("stake"), F.lit(0.0)), F.coalesce(F.sum("profit"), F.lit(0.0))
    return history.groupBy(*scenario).agg(
        F.lit(float(start)).alias("starting_bankroll"), final.alias("final_bankroll"),
        F.coalesce(F.max("peak"), F.lit(float(start))).alias("peak_bankroll"),
        F.coalesce(F.max("drawdown"), F.lit(0.0)).alias("max_drawdown_pct"),
        n.alias("n_bets"), wins.alias("n_wins"), (decided - wins).alias("n_losses"),
        F.try_divide(wins, decided).alias("hit_rate"),
        wagered.alias("total_wagered"), profit.alias("total_profit"),
        F.when(wagered > 0, F.try_divide(profit, wagered)).alias("roi"), (final / start - 1.0).alias("bankroll_growth_pct"),
        F.coalesce(F.avg("stake"), F.lit(0.0)).alias("avg_stake"), F.coalesce(F.avg("kelly"), F.lit(0.0)).alias("avg_kelly"),
        F.coalesce(F.avg("ev_at_bet"), F.lit(0.0)).alias("avg_ev_at_bet"),
        F.when(F.min("growth") > 0, F.sum(F.log("growth"))).alias("log_growth"),
    )


def backtest_by_day(history: DataFrame, scenario: Sequence[str] = ()) -> DataFrame:
    return history.groupBy(*scenario, F.to_date("game_date").alias("date")).agg(
        F.count(F.lit(1)).alias("n_bets"), F.sum("stake").alias("wagered"), F.sum("profit").alias("profit"),
        F.count_if("won").alias("wins"), F.max_by("bankroll_after", "bet_idx").alias("bankroll_end"),
    ).withColumn("roi", F.when(F.col("wagered") > 0, F.col("profit") / F.col("wagered")))


def scenario_slates(slate: DataFrame, thresholds: Sequence[float] = K.SWEEP_THRESHOLDS,
                    max_edges: Sequence[float | None] = (None,)) -> DataFrame:
    """The slate under every (threshold, edge cap): picks re-derived, stakes before the daily cap.

    The grid is a short literal list, exploded per row; no cap is ``infinity``.
    """
    grid = F.array(*[
        F.struct(F.lit(float(t)).alias("ev_threshold"), F.lit(float("inf") if e is None else float(e)).alias("max_edge"))
        for e in max_edges for t in thresholds
    ])
    df = slate.withColumn("_s", F.explode(grid)).select("*", "_s.*").drop("_s")
    df = df.withColumn("recommended", _pick(F.col("ev_threshold"), F.col("max_edge")))
    side = F.col("recommended")
    return df.withColumns({
        "recommended_kelly": _by_side(side, F.col("kelly_home"), F.col("kelly_away")),
        "recommended_ev": _by_side(side, F.col("ev_home"), F.col("ev_away")),
    })


def threshold_sweep(slate: DataFrame, *, thresholds: Sequence[float] = K.SWEEP_THRESHOLDS,
                    max_edges: Sequence[float | None] = (None,), start: float = 100.0,
                    order: Sequence[str] = ("commence_time", "game_id")) -> DataFrame:
    """Back-test every scenario at once; scenarios without a bet report zero bets."""
    asked = [*_SCENARIO, *order, "recommended", "recommended_kelly", "recommended_ev", "home_price_american", "away_price_american", "home_score", "away_score"]
    slates = scenario_slates(slate, thresholds, max_edges).select(*asked)  # every scenario copies the slate, so it is copied narrow
    history = simulate_bankroll(slates, start=start, order=order, scenario=_SCENARIO)
    keep = ["n_bets", "n_wins", "hit_rate", "total_wagered", "total_profit", "roi", "bankroll_growth_pct",
            "max_drawdown_pct", "avg_ev_at_bet", "log_growth"]
    summary = backtest_summary(history, start=start, scenario=_SCENARIO).select(*_SCENARIO, *keep)
    grid = [(float(t), float("inf") if e is None else float(e)) for e in max_edges for t in thresholds]
    every = slate.sparkSession.createDataFrame(grid, "ev_threshold double, max_edge double")
    return every.join(summary, _SCENARIO, "left").withColumns({
        c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_bets", "n_wins")
    })
