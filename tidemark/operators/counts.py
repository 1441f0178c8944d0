"""Event counters and simple grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import constants as K
from tidemark.operators.rows import pa_end_filter


def _flag(condition: Column) -> Column:
    return F.count_if(condition)


def bip_numerator() -> Column:
    """Run value of one plate appearance: the contact estimate when the ball was
    put in play (realised value as fallback), else the realised value."""
    realised = F.col("woba_value").cast("double")
    estimate = F.col("estimated_woba_using_speedangle").cast("double")
    return F.when(F.col("bb_type").isNotNull(), F.coalesce(estimate, realised)).otherwise(
        F.coalesce(realised, F.lit(0.0))
    )


def _event_flags() -> dict[str, Column]:
    ev, bb = F.col("events"), F.col("bb_type")
    return {
        "PA": F.count(ev),
        "SO": _flag(ev.isin(*K.STRIKEOUT_EVENTS)),
        "BB": _flag(ev.isin(*K.WALK_EVENTS)),
        "HBP": _flag(ev == "hit_by_pitch"),
        "_1B": _flag(ev == "single"),
        "_2B": _flag(ev == "double"),
        "_3B": _flag(ev == "triple"),
        "HR": _flag(ev == "home_run"),
        "GB": _flag(bb == "ground_ball"),
        "FB": _flag(bb == "fly_ball"),
        "PU": _flag(bb == "popup"),
        "LD": _flag(bb == "line_drive"),
    }


def daily_counts(pitches: DataFrame, group: str) -> DataFrame:
    """Seventeen counters per (player, season, date); ``group`` is the id column."""
    aggs = _event_flags() | {
        "BBE": _flag(F.col("bb_type").isNotNull()),
        "BARREL": _flag(F.col("launch_speed_angle") == K.BARREL_CODE),
        "WOBA_NUM": F.sum(F.coalesce(F.col("woba_value").cast("double"), F.lit(0.0))),
        "XWOBA_NUM": F.coalesce(F.sum(bip_numerator()), F.lit(0.0)),
        "WOBA_DEN": F.sum(F.coalesce(F.col("woba_denom").cast("double"), F.lit(0.0))),
    }
    return (
        pa_end_filter(pitches)
        .where(F.col(group).isNotNull())
        .groupBy(F.col(group).cast("long").alias("player_id"), "game_year", F.to_date("game_date").alias("game_date"))
        .agg(*[col.alias(name) for name, col in aggs.items()])
    )


def event_counts(pitches: DataFrame, by: str) -> DataFrame:
    """Nine counters and balls in play per entity; rows without the entity are dropped."""
    flags = _event_flags()
    keep = ("PA", "SO", "BB", "HBP", "HR", "GB", "FB", "PU", "LD")
    counted = pa_end_filter(pitches).where(F.col(by).isNotNull()).groupBy(by).agg(
        *[flags[name].alias(name) for name in keep]
    )
    return counted.withColumn("BIP", F.col("GB") + F.col("FB") + F.col("PU") + F.col("LD"))


def modal_value(df: DataFrame, by: Sequence[str], col: str, *, out: str | None = None) -> DataFrame:
    """Most frequent non-missing value per group, smallest value on ties.

    Counts are pre-aggregated per (group, value), so neither a hot group nor a
    wide value domain ends up in one buffer.
    """
    counted = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("neg"), F.col(col).alias("value")))
    return counted.groupBy(*by).agg(best.alias("_best")).select(*by, F.col("_best.value").alias(out or col))


def latest_non_null(df: DataFrame, by: Sequence[str], col: str, ts: str, *, out: str | None = None) -> DataFrame:
    """Value seen last by time; the larger value wins when one instant has several."""
    pick = F.max(F.struct(F.col(ts).alias("ts"), F.col(col).alias("value")))
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(*by)
        .agg(pick.alias("_last"))
        .select(*by, F.col("_last.value").alias(out or col))
    )


def event_outs(events: Column) -> Column:
    """Outs recorded by an event code, 0 for any other."""
    table = F.create_map(*[F.lit(v) for pair in K.OUTS_BY_EVENT.items() for v in pair])
    return F.coalesce(F.try_element_at(table, events), F.lit(0))


def run_value_per_100(pitches: DataFrame, by: Sequence[str] = ("pitch_type",)) -> DataFrame:
    """Run value per hundred pitches from the pitcher's side."""
    return (
        pitches.where(" AND ".join(f"{c} IS NOT NULL" for c in by))
        .groupBy(*by)
        .agg(F.sum("delta_run_exp").alias("sum"), F.count("delta_run_exp").alias("count"))
        .withColumn("rv_per_100", F.try_divide(-100.0 * F.col("sum"), F.col("count")))
    )


def batted_ball_profile(pitches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Expected run value per plate appearance, barrel share and hard-hit share of batted balls."""
    ended = F.col("events").isin(*K.PA_ENDING_EVENTS)
    batted = F.col("bb_type").isNotNull()
    return pitches.groupBy(*by).agg(
        F.avg(F.when(ended, F.col("estimated_woba_using_speedangle"))).alias("xwOBA"),
        F.avg(F.when(batted, F.coalesce(F.col("launch_speed_angle") == K.BARREL_CODE, F.lit(False)).cast("double"))).alias("Barrel_pct"),
        F.avg(F.when(batted, F.coalesce(F.col("launch_speed") >= K.HARD_HIT_SPEED, F.lit(False)).cast("double"))).alias("HardHit_pct"),
        F.count_if(batted).alias("batted_balls"),
    )


def status_counts(games: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Games per status; missing or blank statuses count as ``Unknown``."""
    status = F.coalesce(F.when(F.col("status") != "", F.col("status")), F.lit("Unknown"))
    return games.groupBy(*by, status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def home_records(games: DataFrame) -> DataFrame:
    return games.groupBy("home_name").agg(
        F.count("home_win").alias("home_games"),
        F.bround(F.avg(F.col("home_win").cast("double")), 3).alias("home_win_pct"),
    )


def home_advantage_by_season(games: DataFrame, season: str = "season_year") -> DataFrame:
    home, away = F.col("home_score"), F.col("away_score")
    return games.where(home.isNotNull() & away.isNotNull()).groupBy(season).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(home).alias("home_mean"),
        F.avg(away).alias("away_mean"),
        (F.avg(home) - F.avg(away)).alias("diff"),
        F.avg((home > away).cast("double")).alias("home_win_rate"),
    )
