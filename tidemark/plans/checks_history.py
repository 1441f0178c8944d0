"""Queries: counters, point-in-time indexes and as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions import rates
from tidemark.operators import asof, counts, history, rows
from tidemark.plans import bindings as B, sqlparts as S
from tidemark.plans.registry import big, query, rnd

_SHOW = ("SIERA", "K_pct", "GB_pct", "Barrel_pct", "xwOBA", "PA_cum")


def _starters(spark, d):
    """Both starters of every game: (game_id, side, starter_id, game_date)."""
    return B.starters(spark, d)


_STARTERS_SQL = "SELECT a.game_id, side, pitcher_id AS starter_id, game_date FROM d_arms a JOIN d_games USING (game_id) WHERE seq = 1"


@query("asof_running_rates", B.with_ctes(
    f"""SELECT s.game_id, side, starter_id, s.game_date, {S.rounded(_SHOW, alias='i.')}
    FROM starters s ASOF LEFT JOIN idx i ON s.starter_id = i.player_id AND year(s.game_date) = i.game_year
      AND s.game_date > i.game_date""",
    "d_pitches", "d_arms", extra={"starters": _STARTERS_SQL, **S.index_ctes("idx", "d_pitches", "pitcher")}))
def asof_running_rates(spark, d):
    index = history.season_index(B.pitches(spark, d), "pitcher")
    joined = asof.asof_join(_starters(spark, d), index, by="starter_id", features=_SHOW)
    return joined.select("game_id", "side", "starter_id", "game_date", *[rnd(c).alias(c) for c in _SHOW])


@query("asof_cross_season", B.with_ctes(
    """SELECT s.game_id, side, starter_id, s.game_date, CAST(i.PA_cum AS BIGINT) AS last_PA_cum, i.game_date AS last_date
    FROM starters s ASOF LEFT JOIN idx i ON s.starter_id = i.player_id AND s.game_date > i.game_date""",
    "d_pitches", "d_arms", extra={"starters": _STARTERS_SQL, **S.index_ctes("idx", "d_pitches", "pitcher")}))
def asof_cross_season(spark, d):
    index = history.season_index(B.pitches(spark, d), "pitcher").withColumn("date", F.col("game_date"))
    joined = asof.asof_join(_starters(spark, d), index, by="starter_id", features=["PA_cum", "date"],
                            prefix="last_", same_season=False)
    return joined.select("game_id", "side", "starter_id", "game_date", big("last_PA_cum").alias("last_PA_cum"), "last_date")


@query("asof_lookup", B.with_ctes(
    f"""SELECT player_id, game_date, {S.rounded(_SHOW)} FROM idx
    WHERE player_id = (SELECT min(player_id) FROM idx) AND game_date < DATE '1999-07-01' AND game_year = 1999
    ORDER BY game_date DESC LIMIT 1""", "d_pitches", extra=S.index_ctes("idx", "d_pitches", "pitcher")))
def asof_lookup(spark, d):
    index = history.season_index(B.pitches(spark, d), "pitcher")
    lowest = index.agg(F.min("player_id")).scalar()
    hit = asof.asof_lookup(index, lowest, "1999-07-01")
    return hit.select("player_id", "game_date", *[rnd(c).alias(c) for c in _SHOW])


@query("daily_counts", B.with_ctes(
    f"""SELECT player_id, game_year, game_date, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in K.COUNTERS[:14])},
    {S.rounded(K.COUNTERS[14:])} FROM dc""", "d_pitches", extra={"dc": S.daily("d_pitches", "batter")}))
def daily_counts(spark, d):
    df = counts.daily_counts(B.pitches(spark, d), "batter")
    return df.select("player_id", "game_year", "game_date", *[big(c).alias(c) for c in K.COUNTERS[:14]],
                     *[rnd(c).alias(c) for c in K.COUNTERS[14:]])


_BOTH = [f"{c}{s}" for s in ("", "_30d") for c in ("PA_cum", "SO_cum", "XWOBA_NUM_cum", *K.RATES)]


@query("joint_index", B.with_ctes(
    f"SELECT player_id, game_year, game_date, {S.rounded(_BOTH)} FROM idx", "d_pitches",
    extra=S.index_ctes("idx", "d_pitches", "batter")))
def joint_index(spark, d):
    df = history.joint_index(B.pitches(spark, d), "batter")
    return df.select("player_id", "game_year", "game_date", *[rnd(c).alias(c) for c in _BOTH])


@query("running_totals", B.with_ctes(
    f"SELECT player_id, game_year, game_date, {S.rounded([c + '_cum' for c in K.COUNTERS])} FROM idx_totals", "d_pitches",
    extra=S.index_ctes("idx", "d_pitches", "pitcher")))
def running_totals(spark, d):
    df = history.running_totals(counts.daily_counts(B.pitches(spark, d), "pitcher"))
    return df.select("player_id", "game_year", "game_date", *[rnd(f"{c}_cum").alias(f"{c}_cum") for c in K.COUNTERS])


@query("trailing_30d_sums", """
    SELECT user_id, d AS game_date, CAST(sum(n) OVER w AS BIGINT) AS n_30d, round(sum(v) OVER w, 4) + 0.0 AS value_30d,
      CAST(sum(n) OVER w7 AS BIGINT) AS n_7d
    FROM (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n, sum(value) AS v FROM events GROUP BY 1, 2)
    WINDOW w AS (PARTITION BY user_id ORDER BY d RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW),
      w7 AS (PARTITION BY user_id ORDER BY d RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)""")
def trailing_30d_sums(spark, d):
    ev = B.table(spark, d, "events")
    daily = ev.groupBy(F.col("user_id").alias("player_id"), F.to_date("ts").alias("game_date")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    long = history.trailing_sums(daily, 30, ["n", "v"])
    week = history.trailing_sums(daily, 7, ["n"]).select("player_id", "game_date", F.col("n_cum").alias("n_7d"))
    return long.join(week, ["player_id", "game_date"]).select(
        F.col("player_id").alias("user_id"), "game_date", big("n_cum").alias("n_30d"),
        rnd("v_cum", 4).alias("value_30d"), big("n_7d").alias("n_7d"))


_COUNT_COLS = ("PA", "SO", "BB", "HBP", "HR", "GB", "FB", "PU", "LD")


@query("event_rates", B.with_ctes(
    f"""SELECT *, round(SO::DOUBLE / PA, 9) + 0.0 AS K_pct, round(BB::DOUBLE / PA, 9) + 0.0 AS BB_pct,
      round(HR::DOUBLE / PA, 9) + 0.0 AS HR_pct,
      round(CASE WHEN BIP > 0 THEN GB::DOUBLE / BIP END, 9) + 0.0 AS GB_pct, round(CASE WHEN BIP > 0 THEN FB::DOUBLE / BIP END, 9) + 0.0 AS FB_pct,
      round(CASE WHEN BIP > 0 THEN LD::DOUBLE / BIP END, 9) + 0.0 AS LD_pct, round(CASE WHEN BIP > 0 THEN PU::DOUBLE / BIP END, 9) + 0.0 AS PU_pct,
      round({S.siera('SO', 'BB', 'GB', 'FB', 'PU', 'PA')}, 9) + 0.0 AS SIERA
    FROM (SELECT pitcher, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _COUNT_COLS)},
            CAST(sum(GB + FB + PU + LD) AS BIGINT) AS BIP
          FROM (SELECT player_id AS pitcher, * FROM dc) GROUP BY 1)""", "d_pitches",
    extra={"dc": S.daily("d_pitches", "pitcher")}))
def event_rates(spark, d):
    df = rates.with_count_rates(counts.event_counts(B.pitches(spark, d), "pitcher"))
    df = df.withColumn("SIERA", rates.siera(*[F.col(c) for c in ("SO", "BB", "GB", "FB", "PU", "PA")]))
    return df.select("pitcher", *[big(c).alias(c) for c in (*_COUNT_COLS, "BIP")],
                     *[rnd(c).alias(c) for c in ("K_pct", "BB_pct", "HR_pct", "GB_pct", "FB_pct", "LD_pct", "PU_pct", "SIERA")])


@query("fip_formulas", B.with_ctes(
    """SELECT player_id, game_year,
      round(CASE WHEN ip > 0 THEN (13 * HR + 3 * (BB + HBP) - 2 * SO) / ip END + c, 9) + 0.0 AS fip,
      round(CASE WHEN ip > 0 THEN (13 * (FB * 0.11) + 3 * (BB + HBP) - 2 * SO) / ip END + c, 9) + 0.0 AS xfip
    FROM (SELECT player_id, game_year, sum(HR)::DOUBLE AS HR, sum(BB)::DOUBLE AS BB, sum(HBP)::DOUBLE AS HBP, sum(SO)::DOUBLE AS SO,
            sum(FB)::DOUBLE AS FB, sum(PA - BB - HBP)::DOUBLE / 3 AS ip, CASE game_year + 23 """ + " ".join(f"WHEN {y} THEN {c}" for y, c in K.FIP_CONSTANTS.items()) + f""" ELSE {K.FIP_DEFAULT} END AS c
          FROM dc GROUP BY 1, 2)""", "d_pitches", extra={"dc": S.daily("d_pitches", "pitcher")}))
def fip_formulas(spark, d):
    daily = counts.daily_counts(B.pitches(spark, d), "pitcher")
    df = daily.groupBy("player_id", "game_year").agg(
        *[F.sum(c).alias(c) for c in ("HR", "BB", "HBP", "SO", "FB")], (F.sum(F.col("PA") - F.col("BB") - F.col("HBP")) / 3).alias("ip"))
    const = rates.fip_constant(F.col("game_year") + 23)  # the given years lie before those of the constants
    return df.select(
        "player_id", "game_year",
        rnd(rates.fip(F.col("SO"), F.col("BB"), F.col("HBP"), F.col("HR"), F.col("ip"), const)).alias("fip"),
        rnd(rates.xfip(F.col("SO"), F.col("BB"), F.col("HBP"), F.col("FB"), F.col("ip"), constant=const)).alias("xfip"))


@query("sample_floor", B.with_ctes(
    """SELECT player_id, game_date, CAST(PA_cum AS BIGINT) AS PA_cum,
      round(CASE WHEN PA_cum >= 25 THEN K_pct END, 9) + 0.0 AS K_pct, round(CASE WHEN PA_cum >= 25 THEN xwOBA END, 9) + 0.0 AS xwOBA
    FROM idx""", "d_pitches", extra=S.index_ctes("idx", "d_pitches", "pitcher")))
def sample_floor(spark, d):
    df = rows.sample_floor(history.season_index(B.pitches(spark, d), "pitcher"), ["K_pct", "xwOBA"], "PA_cum", K.STARTER_FLOOR)
    return df.select("player_id", "game_date", big("PA_cum").alias("PA_cum"), rnd("K_pct").alias("K_pct"), rnd("xwOBA").alias("xwOBA"))


@query("batted_ball_profile", B.with_ctes(
    f"""SELECT batter, round(avg(estimated_woba_using_speedangle) FILTER (WHERE events IN {S.in_list(K.PA_ENDING_EVENTS)}), 9) + 0.0 AS xwOBA,
      round(avg((launch_speed_angle = 6)::INT) FILTER (WHERE bb_type IS NOT NULL), 9) + 0.0 AS Barrel_pct,
      round(avg((launch_speed >= 95)::INT) FILTER (WHERE bb_type IS NOT NULL), 9) + 0.0 AS HardHit_pct,
      count(*) FILTER (WHERE bb_type IS NOT NULL) AS batted_balls
    FROM d_pitches GROUP BY 1""", "d_pitches"))
def batted_ball_profile(spark, d):
    df = counts.batted_ball_profile(B.pitches(spark, d), ["batter"])
    return df.select("batter", *[rnd(c).alias(c) for c in ("xwOBA", "Barrel_pct", "HardHit_pct")], big("batted_balls").alias("batted_balls"))


@query("run_value_per_100", B.with_ctes(
    """SELECT pitch_type, round(sum(delta_run_exp), 4) + 0.0 AS sum, count(delta_run_exp) AS count,
      round(-100 * sum(delta_run_exp) / count(delta_run_exp), 9) + 0.0 AS rv_per_100 FROM d_pitches GROUP BY 1""", "d_pitches"))
def run_value_per_100(spark, d):
    df = counts.run_value_per_100(B.pitches(spark, d))
    return df.select("pitch_type", rnd("sum", 4).alias("sum"), big("count").alias("count"), rnd("rv_per_100").alias("rv_per_100"))


@query("season_leaders", B.with_ctes(
    f"""SELECT * FROM (SELECT game_year, player_id, game_date, CAST(PA_cum AS BIGINT) AS PA_cum, round(SIERA, 9) + 0.0 AS SIERA,
      row_number() OVER (PARTITION BY game_year ORDER BY SIERA NULLS LAST, player_id) AS place
    FROM (SELECT *, row_number() OVER (PARTITION BY game_year, player_id ORDER BY game_date DESC) AS rn FROM idx)
    WHERE rn = 1 AND PA_cum >= 20) WHERE place <= 15""", "d_pitches", extra=S.index_ctes("idx", "d_pitches", "pitcher")))
def season_leaders(spark, d):
    index = history.season_index(B.pitches(spark, d), "pitcher")
    final = rows.latest_per_group(index, ["game_year", "player_id"], "game_date")
    return rows.leaderboard(final, "SIERA", 15, floor=("PA_cum", 20), tie=["player_id"], by=["game_year"], place="place").select(
        "game_year", "player_id", "game_date", big("PA_cum").alias("PA_cum"), rnd("SIERA").alias("SIERA"), "place")
