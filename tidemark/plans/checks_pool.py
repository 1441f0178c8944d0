"""Queries: relief pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.operators import bullpen
from tidemark.plans import bindings as B, featuresql as FS, sqlparts as S
from tidemark.plans.registry import big, query, rnd
from tidemark.session import stage

REST, TOP = 2, 8
_NEEDS = ("d_pitches", "d_arms")


@query("appearances", B.with_ctes(
    """SELECT game_id, pitcher_id, game_date, team_id, side, is_starter, hand AS p_throws, pitches, CAST(outs AS BIGINT) AS outs, round(ip, 9) + 0.0 AS "IP" FROM app""",
    *_NEEDS, extra={k: v for k, v in FS.pool_ctes(REST, TOP).items() if k in ("hands", "app")}))
def appearances(spark, d):
    df = bullpen.appearances(B.pitches(spark, d), B.staffs_wide(spark, d))
    return df.select("game_id", "pitcher_id", "game_date", "team_id", "side", "is_starter", "p_throws",
                     big("pitches").alias("pitches"), big("outs").alias("outs"), rnd("IP").alias("IP"))


@query("trailing_pool_topn", B.with_ctes(
    "SELECT team_id, game_date, pitcher_id, round(outs / 3.0::DOUBLE, 9) + 0.0 AS ip FROM pool", "d_whole_pitches", "d_whole_arms", extra=FS.whole_pool_ctes(REST, TOP)))
def trailing_pool_topn(spark, d):
    """Pools of staffs with a pitcher for each supplier, which grow with the data: few pitchers would all be tired in larger tables."""
    worked = bullpen.workloads(B.pitches(spark, d, whole=True), B.staffs_wide(spark, d, whole=True))
    worked = stage(worked.select("team_id", "pitcher_id", "game_date", "is_starter", "pitches", "outs"), "workloads")
    df = bullpen.top_whole_pool(worked, bullpen.pool_dates(worked), top=TOP, rest=REST)
    return df.select("team_id", "game_date", "pitcher_id", rnd("ip").alias("ip"))


#: What counts and roles of pitchers are made from; the other columns of a pitch are not written.
_COUNTED = ("game_pk", "game_date", "game_year", "pitcher", "events", "p_throws", "bb_type", "woba_value", "woba_denom",
            "estimated_woba_using_speedangle", "launch_speed_angle")
_POOL = [f"{h}_{f}{s}" for h in "RL" for s in ("", "_30d") for f in K.RELIEVER_FEATURES]


@query("pool_composites", B.with_ctes(
    f"SELECT team_id, game_date, pool_size, R_pool_size, L_pool_size, {S.rounded(_POOL)} FROM pens", *_NEEDS, extra=FS.pool_ctes(REST, TOP)))
def pool_composites(spark, d):
    pitches = stage(B.pitches(spark, d).select(*_COUNTED), "pitches")
    df = bullpen.bullpen_features(pitches, B.staffs_wide(spark, d), top=TOP, rest=REST)
    return df.select("team_id", "game_date", *[big(c).alias(c) for c in ("pool_size", "R_pool_size", "L_pool_size")],
                     *[rnd(c).alias(c) for c in _POOL])
