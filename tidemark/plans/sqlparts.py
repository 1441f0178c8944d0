"""SQL fragments shared by the oracles (executed by the checker, never by Spark)."""

from __future__ import annotations

from tidemark import constants as K


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def daily(source: str, group: str, where: str = "TRUE") -> str:
    flags = {
        "SO": f"events IN {in_list(K.STRIKEOUT_EVENTS)}", "BB": f"events IN {in_list(K.WALK_EVENTS)}",
        "HBP": "events = 'hit_by_pitch'", "_1B": "events = 'single'", "_2B": "events = 'double'",
        "_3B": "events = 'triple'", "HR": "events = 'home_run'", "GB": "bb_type = 'ground_ball'",
        "FB": "bb_type = 'fly_ball'", "PU": "bb_type = 'popup'", "LD": "bb_type = 'line_drive'",
        "BBE": "bb_type IS NOT NULL", "BARREL": "launch_speed_angle = 6",
    }
    counts = ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in flags.items())
    return f"""SELECT {group} AS player_id, game_year, game_date, count(*) AS PA, {counts},
      sum(coalesce(woba_value, 0)) AS WOBA_NUM,
      coalesce(sum(CASE WHEN bb_type IS NOT NULL THEN coalesce(estimated_woba_using_speedangle, woba_value)
                        ELSE coalesce(woba_value, 0) END), 0) AS XWOBA_NUM,
      sum(woba_denom) AS WOBA_DEN
    FROM {source} WHERE events IN {in_list(K.PA_ENDING_EVENTS)} AND ({where}) GROUP BY 1, 2, 3"""


def totals(source: str) -> str:
    season = ", ".join(f"sum({c}) OVER s AS {c}_cum" for c in K.COUNTERS)
    trailing = ", ".join(f"sum({c}) OVER t AS {c}_cum_30d" for c in K.COUNTERS)
    return f"""SELECT player_id, game_year, game_date, {season}, {trailing} FROM {source}
    WINDOW s AS (PARTITION BY player_id, game_year ORDER BY game_date ROWS UNBOUNDED PRECEDING),
      t AS (PARTITION BY player_id ORDER BY game_date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)"""


def siera(so, bb, gb, fb, pu, pa) -> str:
    k, w, g = f"({so}::DOUBLE / {pa})", f"({bb}::DOUBLE / {pa})", f"(({gb} - {fb} - {pu})::DOUBLE / {pa})"
    return (f"(6.145 - 16.986 * {k} + 11.434 * {w} - 1.858 * {g} + 7.653 * {k} * {k} "
            f"+ 6.664 * (CASE WHEN {w} < 0.105 THEN -{w} * {w} ELSE {w} * {w} END) "
            f"+ 10.130 * {k} * {g} - 5.195 * {w} * {g})")


def rates(source: str, suffixes=("", "_30d")) -> str:
    cols = []
    for s in suffixes:
        def c(n):
            return f"{n}_cum{s}"
        bip = f"({c('GB')} + {c('FB')} + {c('PU')} + {c('LD')})"

        def div(n, d):
            return f"CASE WHEN {d} > 0 THEN {n}::DOUBLE / {d} END"
        cols += [f"{bip} AS BIP_cum{s}"]
        cols += [f"{div(c(n), c('PA'))} AS {o}{s}" for o, n in (("K_pct", "SO"), ("BB_pct", "BB"), ("HR_pct", "HR"))]
        cols += [f"{div(c(n), bip)} AS {n}_pct{s}" for n in ("GB", "FB", "LD", "PU")]
        cols += [f"{div(c('BARREL'), c('BBE'))} AS Barrel_pct{s}", f"{div(c('XWOBA_NUM'), c('WOBA_DEN'))} AS xwOBA{s}",
                 f"{div(c('WOBA_NUM'), c('WOBA_DEN'))} AS wOBA{s}",
                 f"{siera(c('SO'), c('BB'), c('GB'), c('FB'), c('PU'), c('PA'))} AS SIERA{s}"]
    return f"SELECT *, {', '.join(cols)} FROM {source}"


def index_ctes(name: str, source: str, group: str, where: str = "TRUE") -> dict[str, str]:
    return {
        f"{name}_daily": daily(source, group, where),
        f"{name}_totals": totals(f"{name}_daily"),
        name: rates(f"{name}_totals"),
    }


def rounded(columns, digits: int = 9, alias: str = "") -> str:
    return ", ".join(f"round(CAST({alias}{c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in columns)
