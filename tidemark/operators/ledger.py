"""The decision ledger: first-signal-wins merge, closing value, settlement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import constants as K
from tidemark.functions import pricing as P
from tidemark.functions.text_time import eastern_label
from tidemark.operators import odds, rows, scan
from tidemark.schemas import LEDGER, align, parse

_RECONCILED = ("closing_odds", "closing_fair_p", "clv_pp", "closing_snapshot_ts", "home_score", "away_score",
               "outcome", "profit_units")
_SETTLED = ("won", "lost", "push")


def normalise(ledger: DataFrame) -> DataFrame:
    """Ledger schema with defaults; stakes without a size count one unit."""
    return align(ledger, LEDGER).withColumn("risk_units", F.coalesce(F.col("risk_units"), F.lit(1.0)))


def tickets(slate: DataFrame, now) -> DataFrame:
    """Ledger rows for the slate's recommendations, earliest snapshot per game."""
    rec = slate.where(F.col("recommended").isin("home", "away"))
    side = F.col("recommended")

    def pick(home: str, away: str) -> Column:
        have = [c if c in slate.columns else None for c in (home, away)]
        h, a = (F.col(c) if c else F.lit(None).cast("string") for c in have)
        return F.when(side == "home", h).otherwise(a)

    order = [c for c in ("snapshot_ts", "commence_time", "odds_at_rec") if c in rec.columns]
    first = rows.keep_first(rec, ["game_id"], order or ["recommended"])
    cols = {
        "recommended_side": side, "recommended_team": pick("home_name", "away_name"), "book": pick("home_book", "away_book"),
        "odds_at_rec": pick("home_price_american", "away_price_american"), "decimal_at_rec": pick("home_decimal", "away_decimal"),
        "model_p": F.when(side == "home", F.col("p_home")).otherwise(1.0 - F.col("p_home")),
        "fair_p_at_rec": pick("home_fair_p", "away_fair_p"), "edge_at_rec": pick("edge_home", "edge_away"),
        "ev_at_rec": F.col("recommended_ev"), "kelly_at_rec": F.col("recommended_kelly"),
        "kelly_pre_daily": F.col("recommended_kelly_pre_daily"), "rec_snapshot_ts": F.col("snapshot_ts"),
        "rec_logged_at": F.lit(now).cast("timestamp"),
        "lineup_source_home": F.col("home_lineup_source") if "home_lineup_source" in slate.columns else F.lit(None),
        "lineup_source_away": F.col("away_lineup_source") if "away_lineup_source" in slate.columns else F.lit(None),
        "outcome": F.lit("pending"),
    }
    out = first.withColumns({n: c for n, c in cols.items()})
    reset = {c: F.lit(None).cast("double") for c in ("home_score", "away_score")}
    return normalise(out.withColumns(reset))


def merge_recommendations(ledger: DataFrame, slate: DataFrame, now) -> DataFrame:
    """Next ledger version plus an ``action`` column.

    Per game: unseen -> ``inserted``; already started -> ``skipped_post_commence``;
    pick already committed -> ``skipped_paper_locked``; otherwise ``updated``, keeping
    reconciled fields. Untouched rows carry ``kept``.
    """
    names = parse(LEDGER).names
    old = normalise(ledger).select(F.struct(*names).alias("o"), F.col("game_id").alias("_og"))
    new = tickets(slate, now).select(F.struct(*names).alias("n"), F.col("game_id").alias("_ng"))
    both = old.join(new, F.col("_og") == F.col("_ng"), "full")
    started = F.lit(now).cast("timestamp") >= F.col("o.commence_time")
    committed = F.coalesce(F.col("o.recommended_side").isin("home", "away"), F.lit(False))
    action = (
        F.when(F.col("_og").isNull(), "inserted").when(F.col("_ng").isNull(), "kept")
        .when(started, "skipped_post_commence").when(committed, "skipped_paper_locked").otherwise("updated")
    )

    def resolve(name: str) -> Column:
        o, n = F.col(f"o.{name}"), F.col(f"n.{name}")
        updated = F.coalesce(o, n) if name in _RECONCILED else n
        return F.when(F.col("action") == "inserted", n).when(F.col("action") == "updated", updated).otherwise(o).alias(name)

    return both.withColumn("action", action).select(*[resolve(n) for n in names], "action")


def ledger_counts(merged: DataFrame) -> DataFrame:
    """Inserted / updated / skipped tallies of a merge, one row."""
    def n(*actions):
        return F.count_if(F.col("action").isin(*actions))

    return merged.agg(
        n("inserted").alias("inserted"), n("updated").alias("updated"),
        n("skipped_post_commence", "skipped_paper_locked").alias("skipped_locked"),
        n("skipped_post_commence").alias("skipped_post_commence"), n("skipped_paper_locked").alias("skipped_paper_locked"),
    )


def closing_lines(quotes: DataFrame, **options) -> DataFrame:
    """Last line at or before the start, with fair probabilities of both sides."""
    closing = odds.best_lines(quotes, minutes=0, **options)
    fair = P.fair_proportional(P.american_to_implied(F.col("home_price_american")), P.american_to_implied(F.col("away_price_american")))
    return closing.withColumns({"_fair_home": fair[0], "_fair_away": fair[1]})


def reconcile_clv(ledger: DataFrame, quotes: DataFrame, now, **options) -> DataFrame:
    """Fill closing price, fair probability and closing-line value of started bets."""
    log = normalise(ledger)
    c = closing_lines(quotes, **options).select(
        F.col("commence_time").alias("_ct"), F.col("home_team").alias("_h"), F.col("away_team").alias("_a"),
        F.col("snapshot_ts").alias("_ts"), F.col("home_price_american").alias("_ph"), F.col("away_price_american").alias("_pa"),
        "_fair_home", "_fair_away",
    )
    joined = log.join(
        c, (F.col("commence_time") == F.col("_ct")) & (F.col("home_name") == F.col("_h")) & (F.col("away_name") == F.col("_a")), "left")
    due = F.col("clv_pp").isNull() & (F.col("commence_time") <= F.lit(now).cast("timestamp")) & F.col("_ct").isNotNull()
    home = F.col("recommended_side") == "home"
    fair = F.when(home, F.col("_fair_home")).otherwise(F.col("_fair_away"))
    fill = {
        "closing_odds": F.when(home, F.col("_ph")).otherwise(F.col("_pa")), "closing_fair_p": fair,
        "clv_pp": (fair - F.col("fair_p_at_rec")) * 100.0, "closing_snapshot_ts": F.col("_ts"),
    }
    names = parse(LEDGER).names
    return joined.select(*[F.when(due, fill[n]).otherwise(F.col(n)).alias(n) if n in fill else F.col(n) for n in names])


def final_scores(canonical: DataFrame, fallback: DataFrame | None = None, year: str = "season_year") -> DataFrame:
    """One final score per game. A season found in ``canonical`` is taken from there
    only; ``fallback`` serves the seasons it lacks."""
    cols = ["game_id", F.col("home_score").cast("double").alias("home_score"), F.col("away_score").cast("double").alias("away_score")]
    scores = canonical.select(*cols, year)
    if fallback is not None:
        seasons = F.broadcast(canonical.select(year).distinct())  # one row per season
        scores = scores.unionByName(fallback.select(*cols, year).join(seasons, year, "left_anti"))
    return rows.keep_last(scores.dropna(subset=["home_score", "away_score"]), ["game_id"], [year, "home_score", "away_score"]).drop(year)


def reconcile_outcomes(ledger: DataFrame, scores: DataFrame) -> DataFrame:
    """Size stakes, settle finished pending bets and restate every settled profit."""
    log = normalise(ledger)
    log = log.withColumn("kelly_pre_daily", F.coalesce("kelly_pre_daily", "kelly_at_rec"))
    units = P.kelly_to_units(F.col("kelly_pre_daily"), F.coalesce(F.col("risk_ref_kelly"), F.lit(0.0)))
    log = log.withColumn("risk_units", F.coalesce(units, F.col("risk_units")))
    s = scores.select(F.col("game_id"), F.col("home_score").alias("_hs"), F.col("away_score").alias("_as"))
    log = log.join(s, "game_id", "left")
    settle = (F.col("outcome") == "pending") & F.col("_hs").isNotNull() & F.col("_as").isNotNull()
    log = log.withColumns({
        "home_score": F.when(settle, F.col("_hs")).otherwise(F.col("home_score")),
        "away_score": F.when(settle, F.col("_as")).otherwise(F.col("away_score")),
        "outcome": F.when(settle, P.outcome_of(F.col("recommended_side"), F.col("_hs"), F.col("_as"))).otherwise(F.col("outcome")),
    })
    risk = F.coalesce(F.nullif(F.col("risk_units"), F.lit(0.0)), F.lit(1.0))
    profit = P.settle_profit(F.col("outcome"), F.col("decimal_at_rec"), risk)
    log = log.withColumn("profit_units", F.when(F.col("outcome").isin(*_SETTLED), profit).otherwise(F.col("profit_units")))
    return log.select(*parse(LEDGER).names)


def season_filter(ledger: DataFrame, season: int | None) -> DataFrame:
    return ledger if season is None else ledger.where(F.year("commence_time") == season)


def ledger_summary(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts, hit rate, profit, return per unit, mean EV and closing-line value."""
    settled = F.col("outcome").isin(*_SETTLED)
    wins, losses = F.count_if(F.col("outcome") == "won"), F.count_if(F.col("outcome") == "lost")
    profit = F.coalesce(F.sum(F.when(settled, F.coalesce("profit_units", F.lit(0.0)))), F.lit(0.0))
    risk = F.coalesce(F.sum(F.when(settled, F.coalesce("risk_units", F.lit(1.0)))), F.lit(0.0))
    return ledger.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_bets"), F.count_if(settled).alias("n_settled"), F.count_if(~F.coalesce(settled, F.lit(False))).alias("n_pending"),
        wins.alias("n_wins"), losses.alias("n_losses"), (wins / F.greatest(wins + losses, F.lit(1))).alias("hit_rate"),
        profit.alias("profit_units"), (profit / F.greatest(risk, F.lit(1e-9))).alias("roi_per_unit"),
        F.coalesce(F.avg("ev_at_rec"), F.lit(0.0)).alias("avg_ev_at_rec"), F.avg("clv_pp").alias("avg_clv_pp"),
        F.avg(F.when(F.col("clv_pp").isNotNull(), (F.col("clv_pp") > 0).cast("double"))).alias("clv_beat_rate"),
    )


def cumulative_profit(ledger: DataFrame, order: Sequence[str] = ("commence_time", "game_id")) -> DataFrame:
    """Settled bets in time order with running profit and a New York time label."""
    settled = ledger.where(F.col("outcome").isin(*_SETTLED)).withColumn("profit_units", F.coalesce("profit_units", F.lit(0.0)))
    order = list(order)
    ran = scan.running(scan.with_ranges(settled, order), {"cum_profit": ("sum", "profit_units")}, order)
    return ran.withColumn("label", eastern_label(F.col("commence_time"))).drop(scan.BUCKET)


def ledger_view(ledger: DataFrame, schedule: DataFrame | None = None, season: int | None = None) -> dict[str, DataFrame]:
    """Tables behind the tracker page: ``summary``, ``trajectory`` and ``rows``.

    Pending rows name the probable starters from ``schedule``.
    """
    from tidemark.functions.text_time import EASTERN, surname

    log = season_filter(ledger, season)
    rows_ = log
    if schedule is not None:
        probable = schedule.select("game_id", F.col("away_probable_pitcher_name").alias("_ap"), F.col("home_probable_pitcher_name").alias("_hp"))
        rows_ = log.join(rows.keep_last(probable, ["game_id"], ["_ap", "_hp"]), "game_id", "left")
    else:
        rows_ = log.withColumns({"_ap": F.lit(None).cast("string"), "_hp": F.lit(None).cast("string")})
    pending = F.coalesce(F.col("outcome"), F.lit("pending")) == "pending"
    rows_ = rows_.withColumns({
        "away_starter": F.when(pending, surname(F.col("_ap"))), "home_starter": F.when(pending, surname(F.col("_hp"))),
    })
    away, home = F.initcap(F.trim("away_name")), F.initcap(F.trim("home_name"))
    matchup = F.when(pending, F.format_string("%s (%s) @ %s (%s)", away, "away_starter", home, "home_starter")).otherwise(
        F.concat_ws(" @ ", away, home))
    shown = rows_.select(
        "game_id", "commence_time",
        F.concat(F.date_format(F.from_utc_timestamp("commence_time", EASTERN), "EEE MMM dd HH:mm"), F.lit(" ET")).alias("date_label"),
        matchup.alias("matchup"), F.col("recommended_team").alias("pick"), "book", "risk_units", "odds_at_rec", "model_p",
        "fair_p_at_rec", "edge_at_rec", "ev_at_rec", "closing_odds", "clv_pp",
        F.coalesce("outcome", F.lit("pending")).alias("outcome"), "profit_units",
    )
    return {"summary": ledger_summary(log), "trajectory": cumulative_profit(log), "rows": shown}
