"""Explicit schemas (as DDL) for every source and the ledger, plus the aligner."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

EVENTS = (
    "game_pk long, game_date date, game_year int, game_type string, pitcher long, batter long, "
    "stand string, p_throws string, events string, bb_type string, description string, "
    "pitch_type string, pitch_name string, delta_run_exp double, woba_value double, "
    "woba_denom double, estimated_woba_using_speedangle double, launch_speed double, "
    "launch_angle double, launch_speed_angle int, home_team string, away_team string, "
    "balls int, strikes int"
)

_OUTCOME_GAME = (
    "game_id long, game_date string, game_datetime string, game_type string, status string, "
    "home_id long, home_name string, away_id long, away_name string, home_score string, "
    "away_score string, winning_team string, losing_team string, winning_pitcher string, "
    "losing_pitcher string, save_pitcher string, home_probable_pitcher string, "
    "away_probable_pitcher string, venue_id long, venue_name string, doubleheader string, game_num int"
)
OUTCOME_GAME = _OUTCOME_GAME
OUTCOMES_DOC = (
    "fetched_at_utc string, game_date string, sport string, game_count int, "
    f"status_counts map<string,int>, data array<struct<{_OUTCOME_GAME.replace(' ', ':').replace(',:', ', ')}>>"
)

_PLAYER = (
    "struct<person: struct<fullName: string>, position: struct<abbreviation: string>, "
    "allPositions: array<struct<abbreviation: string>>>"
)
_SIDE = (
    "struct<team: struct<id: long>, battingOrder: array<long>, pitchers: array<long>, "
    f"bullpen: array<long>, players: map<string, {_PLAYER}>>"
)
BOXSCORE_DOC = (f"gameId string, home {_SIDE}, away {_SIDE}")

ODDS_DOC = (
    "fetched_at_utc string, sport string, regions string, markets string, odds_format string, "
    "requests_used string, requests_remaining string, last_request_cost string, game_count int, "
    "data array<struct<id: string, commence_time: string, home_team: string, away_team: string, "
    "bookmakers: array<struct<key: string, title: string, markets: array<struct<key: string, "
    "last_update: string, outcomes: array<struct<name: string, price: double>>>>>>>>"
)

_SCHEDULE_GAME = (
    "game_id long, game_date string, game_datetime string, game_type string, status string, "
    "abstract_status string, home_id long, home_name string, away_id long, away_name string, "
    "home_probable_pitcher_id long, home_probable_pitcher_name string, home_probable_pitcher_throws string, "
    "away_probable_pitcher_id long, away_probable_pitcher_name string, away_probable_pitcher_throws string, "
    "venue_id long, venue_name string, doubleheader string, game_num int"
)
SCHEDULE_DOC = (
    "schema_version int, sport string, game_date string, captured_at_utc string, game_count int, "
    f"data array<struct<{_SCHEDULE_GAME.replace(' ', ':').replace(',:', ', ')}>>"
)

OAA = (
    "player_id long, primary_pos_formatted string, display_team_name string, year int, "
    "outs_above_average double, outs_above_average_rhh double, outs_above_average_lhh double, "
    "fielding_runs_prevented double, diff_success_rate_formatted string, position_abbrev string, "
    "position_code int, attempts long"
)
PARK_FACTORS = (
    "bat_side string, venue_id long, venue_name string, main_team_id long, name_display_club string, "
    "n_pa long, year_range string, index_xwobacon double, index_runs double, index_hr double, "
    "index_2b double, index_3b double, index_1b double, index_woba double, index_wobacon double, "
    "index_bb double, index_so double, fetched_year int"
)
LINEUPS_WIDE = (
    "game_id long, game_id_str string, home_team_id long, away_team_id long, home_starter_id long, "
    "away_starter_id long, home_lineup array<long>, away_lineup array<long>, "
    "home_lineup_positions array<string>, away_lineup_positions array<string>, "
    "home_pitchers_used array<long>, away_pitchers_used array<long>, "
    "home_bullpen_pregame array<long>, away_bullpen_pregame array<long>, box_path string"
)
PUBLISHED_LINEUPS = (
    "game_id long, home_lineup array<long>, away_lineup array<long>, home_positions array<string>, "
    "away_positions array<string>, home_starter_id long, away_starter_id long"
)
LEDGER = (
    "game_id long, game_date date, commence_time timestamp, home_id long, away_id long, "
    "home_name string, away_name string, recommended_side string, recommended_team string, "
    "book string, odds_at_rec double, decimal_at_rec double, model_p double, fair_p_at_rec double, "
    "edge_at_rec double, ev_at_rec double, kelly_at_rec double, kelly_pre_daily double, "
    "risk_ref_kelly double, risk_units double, rec_snapshot_ts timestamp, rec_logged_at timestamp, "
    "lineup_source_home string, lineup_source_away string, closing_odds double, "
    "closing_fair_p double, clv_pp double, closing_snapshot_ts timestamp, home_score double, "
    "away_score double, outcome string, profit_units double"
)
MODEL = (
    "feature_set string, feature string, position int, impute double, mean double, scale double, "
    "coef double, intercept double, train_n long, target_mean double, target_std double"
)


def parse(ddl: str) -> StructType:
    """Schema object of a DDL string (needs an active session)."""
    return StructType.fromDDL(ddl)


def align(df: DataFrame, ddl: str, *, keep_extra: bool = False) -> DataFrame:
    """Cast to the columns of ``ddl``, adding typed NULLs for the missing ones."""
    schema = parse(ddl)
    have = set(df.columns)
    cols = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    if keep_extra:
        cols += [F.col(c) for c in df.columns if c not in schema.names]
    return df.select(*cols)
