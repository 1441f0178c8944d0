"""Code lists, lookup tables and coefficients.

These must equal the published / domain values for results to be right, so they
are stated plainly here and nowhere else.
"""

from __future__ import annotations

# --- event codes -----------------------------------------------------------
PA_ENDING_EVENTS = (
    "single", "double", "triple", "home_run",
    "walk", "intent_walk",
    "strikeout", "strikeout_double_play",
    "field_out", "force_out", "grounded_into_double_play",
    "double_play", "triple_play",
    "sac_fly", "sac_bunt", "sac_fly_double_play",
    "hit_by_pitch",
    "field_error", "fielders_choice", "fielders_choice_out",
    "catcher_interf",
)
STRIKEOUT_EVENTS = ("strikeout", "strikeout_double_play")
WALK_EVENTS = ("walk", "intent_walk")
OUTS_BY_EVENT = {
    "field_out": 1, "force_out": 1, "fielders_choice_out": 1,
    "strikeout": 1, "sac_fly": 1, "sac_bunt": 1,
    "grounded_into_double_play": 2, "double_play": 2,
    "strikeout_double_play": 2, "sac_fly_double_play": 2,
    "triple_play": 3,
}
BARREL_CODE = 6
HARD_HIT_SPEED = 95.0

# --- counters kept per player-day -----------------------------------------
COUNTERS = (
    "PA", "SO", "BB", "HBP", "_1B", "_2B", "_3B", "HR",
    "GB", "FB", "PU", "LD", "BBE", "BARREL",
    "WOBA_NUM", "XWOBA_NUM", "WOBA_DEN",
)
RATES = (
    "BIP_cum", "K_pct", "BB_pct", "HR_pct", "GB_pct", "FB_pct", "LD_pct",
    "PU_pct", "Barrel_pct", "xwOBA", "wOBA", "SIERA",
)

# --- feature lists ---------------------------------------------------------
ASOF_FEATURES = (
    "SIERA", "K_pct", "BB_pct", "HR_pct", "GB_pct", "FB_pct", "LD_pct",
    "PU_pct", "Barrel_pct", "xwOBA", "PA_cum", "BBE_cum",
)
STARTER_FEATURES = (
    "SIERA", "K_pct", "BB_pct", "HR_pct", "GB_pct", "FB_pct", "LD_pct",
    "PU_pct", "Barrel_pct", "xwOBA", "PA_cum",
)
HITTER_FEATURES = (
    "K_pct", "BB_pct", "HR_pct", "GB_pct", "FB_pct", "LD_pct",
    "Barrel_pct", "xwOBA", "PA_cum",
)
RELIEVER_FEATURES = (
    "xwOBA", "SIERA", "Barrel_pct", "GB_pct", "FB_pct", "LD_pct", "PU_pct", "PA_cum",
)
FLIGHTS = ("GB_pct", "FB_pct", "LD_pct", "PU_pct")

# Sample floors (plate appearances) for season and trailing windows.
STARTER_FLOOR, STARTER_FLOOR_TRAILING = 25, 50
HITTER_FLOOR, HITTER_FLOOR_TRAILING = 25, 15
TRAILING_DAYS = 30
TRAILING_SUFFIX = "_30d"

# --- batting order ---------------------------------------------------------
RAW_SLOT_SHARES = (0.122, 0.116, 0.111, 0.107, 0.103, 0.099, 0.095, 0.091, 0.088)
SLOT_WEIGHTS = tuple(share / sum(RAW_SLOT_SHARES) for share in RAW_SLOT_SHARES)
LINEUP_SLOTS = 9

# --- starter / staff blend -------------------------------------------------
STARTER_WEIGHT_MIN, STARTER_WEIGHT_MAX = 0.25, 0.85
LEAGUE_IP_PER_START = 5.5

# --- run-value coefficients ------------------------------------------------
FIP_CONSTANTS = {
    2018: 3.16, 2019: 3.21, 2020: 3.20, 2021: 3.17, 2022: 3.13,
    2023: 3.13, 2024: 3.13, 2025: 3.13, 2026: 3.13,
}
FIP_DEFAULT = 3.13
HR_PER_FLY = 0.11
PYTHAG_EXPONENT = 1.83
WOBA_EVENT_WEIGHTS = {
    "BB": 0.690, "HBP": 0.720, "1B": 0.880, "2B": 1.270, "3B": 1.620, "HR": 2.100,
}
WOBA_BY_FLIGHT = {"GB": 0.210, "FB": 0.340, "LD": 0.685, "PU": 0.010}
EVENT_SHARE_BY_FLIGHT = {
    "LD": {"1B": 0.50, "2B": 0.15, "3B": 0.02, "HR": 0.03},
    "FB": {"1B": 0.02, "2B": 0.03, "3B": 0.01, "HR": 0.09},
}
LEAGUE_FLIGHT_MIX = {"GB": 0.43, "FB": 0.33, "LD": 0.20, "PU": 0.04}
PITCHER_BLEND = 0.60
DEFENSE_PER_FLIGHT = 0.00115
DEFENSE_PER_RUN = 0.0011

# --- fielding --------------------------------------------------------------
INFIELD = ("1B", "2B", "3B", "SS")
OUTFIELD = ("LF", "CF", "RF")
FIELDING = INFIELD + OUTFIELD
POSITION_PRIORITY = ("C", "SS", "2B", "3B", "1B", "CF", "LF", "RF", "DH")
STARTS_TARGET_PERCENTILE = 0.80
POSITION_CODES = {3: "1B", 4: "2B", 5: "3B", 6: "SS", 7: "LF", 8: "CF", 9: "RF"}

# --- relief pool -----------------------------------------------------------
POOL_TOP_N = 8
POOL_DAYS = 30
REST_PITCHES = 20

# --- line-up projection ----------------------------------------------------
SHORT_LOOKBACK_DAYS = 14
PLATOON_LOOKBACK_DAYS = 30
MIN_PLATOON_GAMES = 3
ASSIGNMENT_TOP_N = 15

# --- outcomes --------------------------------------------------------------
FINAL_STATUSES = ("Final", "Completed Early")
REGULAR_TYPES = ("R",)
POSTSEASON_TYPES = ("F", "D", "L", "W")

# --- markets ---------------------------------------------------------------
DEFAULT_BOOKS = ("draftkings", "fanduel", "betmgm")
EXTREME_PRICE = 500
CLOSE_MINUTES = 30
KELLY_CAP = 0.01
KELLY_MULTIPLIER = 0.0625
KELLY_REF_MULTIPLE = 2.0
MAX_EDGE = 0.07
DAILY_STAKE_CAP = 0.05
UNITS_MIN, UNITS_MAX = 0.5, 2.0
SWEEP_THRESHOLDS = (0.0, 0.01, 0.02, 0.03, 0.05, 0.08, 0.10, 0.15, 0.20)

# --- run model -------------------------------------------------------------
HOME_RUNS_BONUS = 0.27
RIDGE_ALPHA = 1.0
PROB_EPS = 1e-9
FEATURES_DEFAULT = (
    "off_xwOBA_matchup_adj", "off_Barrel_pct", "off_HR_pct", "off_BB_pct",
    "opp_sp_SIERA", "opp_sp_xwOBA_matchup_adj", "opp_sp_Barrel_pct", "is_home",
)
FEATURES_BASELINE = (
    "off_xwOBA", "off_Barrel_pct", "off_HR_pct", "off_BB_pct",
    "opp_sp_SIERA", "opp_sp_xwOBA", "opp_sp_Barrel_pct", "is_home",
)
FEATURES_TRAILING = (
    "off_xwOBA_30d_matchup_adj", "off_Barrel_pct_30d", "off_HR_pct_30d", "off_BB_pct_30d",
    "opp_sp_SIERA_30d", "opp_sp_xwOBA_30d_matchup_adj", "opp_sp_Barrel_pct_30d", "is_home",
)
FEATURES_COMBINED = FEATURES_DEFAULT + (
    "off_xwOBA_30d_matchup_adj", "opp_sp_xwOBA_30d_matchup_adj",
)
FEATURES_BULLPEN = FEATURES_COMBINED + ("opp_bp_xwOBA_matchup_adj", "opp_bp_SIERA_matchup")
FEATURES_EVERYTHING = (
    "off_xwOBA", "off_Barrel_pct", "off_HR_pct", "off_K_pct", "off_BB_pct",
    "opp_sp_SIERA", "opp_sp_xwOBA", "opp_sp_Barrel_pct",
    "opp_sp_K_pct", "opp_sp_BB_pct", "opp_sp_HR_pct", "is_home",
)
FEATURE_SETS = {
    "default": FEATURES_DEFAULT,
    "baseline": FEATURES_BASELINE,
    "trailing": FEATURES_TRAILING,
    "combined": FEATURES_COMBINED,
    "bullpen": FEATURES_BULLPEN,
    "everything": FEATURES_EVERYTHING,
}

# --- team id -> venue code -------------------------------------------------
TEAM_CODES = {
    108: "LAA", 109: "ARI", 110: "BAL", 111: "BOS", 112: "CHC", 113: "CIN",
    114: "CLE", 115: "COL", 116: "DET", 117: "HOU", 118: "KC", 119: "LAD",
    120: "WSH", 121: "NYM", 133: "OAK", 134: "PIT", 135: "SD", 136: "SEA",
    137: "SF", 138: "STL", 139: "TB", 140: "TEX", 141: "TOR", 142: "MIN",
    143: "PHI", 144: "ATL", 145: "CWS", 146: "MIA", 147: "NYY", 158: "MIL",
}

# --- append keys -----------------------------------------------------------
PITCH_DEDUPE_KEYS = ("game_pk", "batter", "pitcher", "balls", "strikes", "description")

# Columns of a priced slate, in order.
SLATE_COLUMNS = (
    "game_id", "game_date", "commence_time", "home_id", "away_id", "home_name", "away_name", "home_score", "away_score",
    "home_runs_pred", "away_runs_pred", "p_home", "snapshot_ts", "n_books", "home_price_american", "away_price_american",
    "home_book", "away_book", "home_decimal", "away_decimal", "home_implied", "away_implied", "home_fair_p", "away_fair_p",
    "vig", "edge_home", "edge_away", "ev_home", "ev_away", "kelly_home", "kelly_away", "recommended", "recommended_ev",
    "recommended_kelly", "recommended_kelly_pre_daily", "risk_ref_kelly", "risk_units", "home_lineup_source", "away_lineup_source",
)
