"""Queries: quotes, pricing, decisions, back-test and ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions import contact, pricing as P
from tidemark.operators import bets, ledger, odds
from tidemark.plans import bindings as B, features, sqlparts as S
from tidemark.plans.registry import big, epoch, query, rnd
from tidemark.session import stage

_BOOKS_SQL = S.in_list(K.DEFAULT_BOOKS)


def _dec(price: str) -> str:
    return f"(CASE WHEN {price} >= 0 THEN 1.0 + {price} / 100.0 ELSE 1.0 + 100.0 / abs({price}) END)"


# --- best lines -------------------------------------------------------------

def lines_sql(minutes: int, strategy: str = "best") -> dict[str, str]:
    ok = "abs(home_price_american) <= 500 AND abs(away_price_american) <= 500"
    fold = {
        "best": """max(home_price_american) AS home_price_american, max(away_price_american) AS away_price_american,
          arg_min(book_title, (-home_price_american, book_title)) AS home_book, arg_min(book_title, (-away_price_american, book_title)) AS away_book""",
        "median": "median(home_price_american) AS home_price_american, median(away_price_american) AS away_price_american, NULL::VARCHAR AS home_book, NULL::VARCHAR AS away_book",
        "mean": "avg(home_price_american) AS home_price_american, avg(away_price_american) AS away_price_american, NULL::VARCHAR AS home_book, NULL::VARCHAR AS away_book",
    }[strategy]
    return {
        "pre": f"""SELECT *, max(snapshot_ts) OVER (PARTITION BY commence_time, home_team, away_team) AS chosen FROM d_quotes
          WHERE book_key IN {_BOOKS_SQL} AND snapshot_ts <= commence_time - INTERVAL {minutes} MINUTE""",
        "lines": f"""SELECT commence_time, home_team, away_team, chosen AS snapshot_ts, count(DISTINCT book_key) AS n_books, {fold}
          FROM pre WHERE snapshot_ts = chosen AND {ok} GROUP BY 1, 2, 3, 4""",
    }


_LINES_OUT = """SELECT CAST(epoch(commence_time) AS BIGINT) AS start_s, home_team, away_team, CAST(epoch(snapshot_ts) AS BIGINT) AS snapshot_s,
  CAST(n_books AS BIGINT) AS n_books, round(home_price_american, 6) + 0.0 AS home_price, round(away_price_american, 6) + 0.0 AS away_price, home_book, away_book FROM lines"""


def _lines_out(df):
    return df.select(epoch("commence_time").alias("start_s"), "home_team", "away_team", epoch("snapshot_ts").alias("snapshot_s"),
                     big("n_books").alias("n_books"), rnd("home_price_american", 6).alias("home_price"),
                     rnd("away_price_american", 6).alias("away_price"), "home_book", "away_book")


@query("best_lines", B.with_ctes(_LINES_OUT, "d_quotes", extra=lines_sql(30)))
def best_lines(spark, d):
    return _lines_out(odds.best_lines(B.quotes(spark, d)))


@query("best_lines_median", B.with_ctes(_LINES_OUT, "d_quotes", extra=lines_sql(30, "median")))
def best_lines_median(spark, d):
    return _lines_out(odds.best_lines(B.quotes(spark, d), strategy="median"))


@query("best_lines_mean", B.with_ctes(_LINES_OUT, "d_quotes", extra=lines_sql(0, "mean")))
def best_lines_mean(spark, d):
    return _lines_out(odds.best_lines(B.quotes(spark, d), strategy="mean", minutes=0))


@query("latest_before_cutoff", B.with_ctes(
    """SELECT game_id, count(*) AS n, CAST(epoch(max(snapshot_ts)) AS BIGINT) AS snapshot_s FROM (
      SELECT *, max(snapshot_ts) OVER (PARTITION BY game_id) AS chosen FROM d_quotes WHERE snapshot_ts <= commence_time - INTERVAL 30 MINUTE)
    WHERE snapshot_ts = chosen GROUP BY 1""", "d_quotes"))
def latest_before_cutoff(spark, d):
    df = odds.latest_before_cutoff(B.quotes(spark, d), ["game_id"])
    return df.groupBy("game_id").agg(F.count(F.lit(1)).alias("n"), epoch(F.max("snapshot_ts")).alias("snapshot_s"))


@query("attach_team_ids", B.with_ctes(
    """SELECT s_suppkey, home_id, away_id, CASE WHEN home_id IS NULL OR away_id IS NULL THEN 'rejected' ELSE 'matched' END AS verdict FROM (
      SELECT s_suppkey, h.id AS home_id, a.id AS away_id FROM (SELECT s_suppkey, 'Team ' || (100 + s_nationkey * 2) AS hn, 'Team ' || (108 + s_suppkey % 40) AS an FROM supplier)
      LEFT JOIN t h ON hn = h.name LEFT JOIN t a ON an = a.name)""", "d_games",
    extra={"t": "SELECT home_name AS name, home_id AS id FROM d_games UNION SELECT away_name, away_id FROM d_games"}))
def attach_team_ids(spark, d):
    s = B.table(spark, d, "supplier").select(
        "s_suppkey", F.concat(F.lit("Team "), (100 + F.col("s_nationkey") * 2).cast("string")).alias("home_team"),
        F.concat(F.lit("Team "), (108 + F.col("s_suppkey") % 40).cast("string")).alias("away_team"))
    good, bad = odds.attach_team_ids(s, odds.team_keys(B.games(spark, d)))
    cols = ["s_suppkey", "home_id", "away_id"]
    return good.select(*cols, F.lit("matched").alias("verdict")).unionByName(bad.select(*cols, F.lit("rejected").alias("verdict")))


# --- a priced slate from orders ---------------------------------------------------

def slate_input(spark, d):
    """Every game with a two-sided price and a model probability."""
    g = B.games(spark, d, keep=("o_custkey", "o_totalprice"))
    raw = (F.floor("o_totalprice") % 341 - 170).cast("double")
    home = F.when(raw >= 0, raw + 100).otherwise(raw - 100)
    return g.select(
        "game_id", "game_date", "commence_time", "season_year", "home_id", "away_id", "home_name", "away_name", "home_score", "away_score",
        home.alias("home_price_american"), F.when(raw >= 0, -raw - 118).otherwise(-raw + 82).alias("away_price_american"),
        (F.lit(0.30) + (F.col("o_custkey") % 41) / 100.0).alias("p_home"),
        (F.col("commence_time") - F.make_interval(hours=F.lit(2))).alias("snapshot_ts"),
        F.lit("BOOK H").alias("home_book"), F.lit("BOOK A").alias("away_book"))


_SLATE = """SELECT game_id, game_date, commence_time, season_year, home_id, away_id, home_name, away_name, home_score, away_score,
    CAST(CASE WHEN raw >= 0 THEN raw + 100 ELSE raw - 100 END AS DOUBLE) AS hp, CAST(CASE WHEN raw >= 0 THEN -raw - 118 ELSE -raw + 82 END AS DOUBLE) AS ap,
    0.30::DOUBLE + (o_custkey % 41) / 100.0::DOUBLE AS p_home
  FROM d_games JOIN (SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice) AS BIGINT) % 341 - 170 AS raw FROM orders) ON game_id = o_orderkey"""


def bets_sql(slate: str, max_edge: float | None = K.MAX_EDGE, daily: float = K.DAILY_STAKE_CAP) -> dict[str, str]:
    def kelly(p, dec):
        return f"least(greatest((({dec} - 1) * {p} - (1 - {p})) / ({dec} - 1), 0) * 0.0625, 0.01)"

    edge = (lambda s: f" AND abs(edge_{s}) <= {max_edge}") if max_edge is not None else (lambda s: "")
    part = f"PARTITION BY {slate}" if slate else ""
    return {
        "s0": _SLATE,
        "s1": f"SELECT *, {_dec('hp')} AS hd, {_dec('ap')} AS ad, 1 / {_dec('hp')} AS hi, 1 / {_dec('ap')} AS ai FROM s0",
        "s2": """SELECT *, hi / (hi + ai) AS hf, ai / (hi + ai) AS af, hi + ai - 1 AS vig, p_home - hi / (hi + ai) AS edge_home,
          (1 - p_home) - ai / (hi + ai) AS edge_away, p_home * hd - 1 AS ev_home, (1 - p_home) * ad - 1 AS ev_away FROM s1""",
        "s3": f"""SELECT *, {kelly('p_home', 'hd')} AS kelly_home, {kelly('(1 - p_home)', 'ad')} AS kelly_away,
          CASE WHEN ev_home > ev_away AND ev_home > 0{edge('home')} THEN 'home' WHEN ev_away > ev_home AND ev_away > 0{edge('away')} THEN 'away' ELSE '' END AS rec FROM s2""",
        "s4": """SELECT *, CASE rec WHEN 'home' THEN kelly_home WHEN 'away' THEN kelly_away ELSE 0 END AS pre,
          CASE rec WHEN 'home' THEN ev_home WHEN 'away' THEN ev_away ELSE 0 END AS rev FROM s3""",
        "s5": f"""SELECT *, avg(pre) FILTER (WHERE rec <> '') OVER ({part}) AS mean_k, sum(pre) OVER ({part}) AS total_k FROM s4""",
        "annotated": f"""SELECT *, CASE WHEN rec <> '' THEN CASE WHEN mean_k > 0 THEN mean_k ELSE 0.00125 END END AS ref,
          CASE WHEN rec <> '' THEN least(greatest(pre / CASE WHEN mean_k > 0 THEN mean_k ELSE 0.00125 END, 0.5), 2.0) END AS units,
          coalesce(total_k > {daily}, FALSE) AS scaled, CASE WHEN total_k > {daily} THEN {daily} / total_k ELSE 1.0 END AS factor,
          pre * CASE WHEN total_k > {daily} THEN {daily} / total_k ELSE 1.0 END AS rk FROM s5""",
    }


_ANN = {"hd": "home_decimal", "hf": "home_fair_p", "vig": "vig", "edge_home": "edge_home", "ev_home": "ev_home", "ev_away": "ev_away",
        "kelly_home": "kelly_home", "kelly_away": "kelly_away", "rev": "recommended_ev", "pre": "recommended_kelly_pre_daily",
        "ref": "risk_ref_kelly", "units": "risk_units", "factor": "daily_stake_scale_factor", "rk": "recommended_kelly"}
_ANN_SQL = "SELECT game_id, rec AS recommended, scaled AS daily_stake_scaled, " + ", ".join(
    f"round(CAST({s} AS DOUBLE), 9) + 0.0 AS {n}" for s, n in _ANN.items()) + " FROM annotated"


def _ann_out(df):
    return df.select("game_id", "recommended", "daily_stake_scaled", *[rnd(n).alias(n) for n in _ANN.values()])


@query("annotate_bets_daily", B.with_ctes(_ANN_SQL, "d_games", extra=bets_sql("game_date")))
def annotate_bets_daily(spark, d):
    return _ann_out(bets.annotate_bets(slate_input(spark, d), slate_keys=["game_date"]))


@query("annotate_bets_one_slate", B.with_ctes(_ANN_SQL, "d_games", extra=bets_sql("")))
def annotate_bets_one_slate(spark, d):
    return _ann_out(bets.annotate_bets(slate_input(spark, d)))


@query("remove_vig_power", """
    WITH RECURSIVE q AS (SELECT o_orderkey, 1 / """ + _dec("hp") + " AS hi, 1 / " + _dec("ap") + """ AS ai
      FROM (SELECT o_orderkey, CAST(CASE WHEN raw >= 0 THEN raw + 100 ELSE raw - 100 END AS DOUBLE) AS hp, CAST(CASE WHEN raw >= 0 THEN -raw - 118 ELSE -raw + 82 END AS DOUBLE) AS ap
          FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 341 - 170 AS raw FROM orders))),
    halves AS (SELECT DISTINCT hi, ai, 0 AS step, 0.5::DOUBLE AS lo, 2.0::DOUBLE AS up FROM q UNION ALL
      SELECT hi, ai, step + 1, CASE WHEN above THEN mid ELSE lo END, CASE WHEN above THEN up ELSE mid END
      FROM (SELECT *, (lo + up) / 2 AS mid, pow(hi, (lo + up) / 2) + pow(ai, (lo + up) / 2) > 1 AS above FROM halves WHERE step < 64))
    SELECT o_orderkey, round(pow(hi, (lo + up) / 2), 7) + 0.0 AS fair_home, round(pow(ai, (lo + up) / 2), 7) + 0.0 AS fair_away, round(hi / (hi + ai), 6) + 0.0 AS proportional
    FROM q JOIN halves USING (hi, ai) WHERE step = 64""")
def remove_vig_power(spark, d):
    s = slate_input(spark, d)
    hi, ai = P.american_to_implied(F.col("home_price_american")), P.american_to_implied(F.col("away_price_american"))
    s = s.withColumns({"hi": hi, "ai": ai})
    fair = P.remove_vig(F.col("hi"), F.col("ai"), "power")
    prop = P.remove_vig(F.col("hi"), F.col("ai"))
    return s.select(F.col("game_id").alias("o_orderkey"), rnd(fair[0], 7).alias("fair_home"), rnd(fair[1], 7).alias("fair_away"), rnd(prop[0], 6).alias("proportional"))


@query("price_conversions", """
    SELECT a, round(CASE WHEN a >= 0 THEN 1 + a / 100 ELSE 1 + 100 / abs(a) END, 9) + 0.0 AS dec,
      round(CASE WHEN a > 0 THEN 100 / (a + 100) ELSE -a / (-a + 100) END, 9) + 0.0 AS legacy,
      round(0.5 * CASE WHEN a > 0 THEN a / 100 ELSE 100 / nullif(-a, 0) END - 0.5, 9) + 0.0 AS ev_half, n
    FROM (SELECT CAST(floor(o_totalprice) AS BIGINT) % 401 - 200.0::DOUBLE AS a, count(*) AS n FROM orders GROUP BY 1)""")
def price_conversions(spark, d):
    a = (F.floor("o_totalprice") % 401 - 200).cast("double")
    df = B.table(spark, d, "orders").groupBy(a.alias("a")).agg(F.count(F.lit(1)).alias("n"))
    return df.select("a", rnd(P.american_to_decimal(F.col("a"))).alias("dec"), rnd(P.american_to_implied_legacy(F.col("a"))).alias("legacy"),
                     rnd(P.expected_value_american(F.lit(0.5), F.col("a"))).alias("ev_half"), "n")


# --- back-test ------------------------------------------------------------------

# Enough stake per bet that the compounding shows, little enough that it stays finite.
_WIN = "((rec = 'home' AND home_score > away_score) OR (rec = 'away' AND away_score > home_score))"


def bankroll_sql() -> dict[str, str]:
    return {
        **bets_sql("game_date"),
        "bt0": f"""SELECT *, CASE WHEN home_score = away_score THEN 0 WHEN {_WIN} THEN rk * (CASE WHEN rec = 'home' THEN hd ELSE ad END - 1) ELSE -rk END AS step,
          row_number() OVER (ORDER BY commence_time, game_id) - 1 AS bet_idx FROM annotated WHERE rec <> '' AND rk >= 0""",
        "bt1": "SELECT *, 100 * exp(sum(ln(1 + step)) OVER (ORDER BY commence_time, game_id)) AS bank FROM bt0",
        "bt": "SELECT *, greatest(max(bank) OVER (ORDER BY commence_time, game_id), 100) AS peak, bank / (1 + step) * rk AS stake, bank / (1 + step) * step AS profit FROM bt1",
    }


def _history(spark, d):
    slate = bets.annotate_bets(slate_input(spark, d), slate_keys=["game_date"])
    return bets.simulate_bankroll(stage(slate, "slate"))


@query("bankroll_history", B.with_ctes(
    """SELECT game_id, CAST(bet_idx AS BIGINT) AS bet_idx, round(bank, 5) + 0.0 AS bankroll_after, round((peak - bank) / peak + 1.7e-8, 7) + 0.0 AS drawdown,
      round(stake, 6) + 0.0 AS stake FROM bt""", "d_games", extra=bankroll_sql()))
def bankroll_history(spark, d):
    return _history(spark, d).select("game_id", big("bet_idx").alias("bet_idx"), rnd("bankroll_after", 5).alias("bankroll_after"),
                                     rnd(F.col("drawdown") + 1.7e-8, 7).alias("drawdown"), rnd("stake", 6).alias("stake"))


@query("backtest_summary", B.with_ctes(
    f"""SELECT round(arg_max(bank, bet_idx), 4) + 0.0 AS final_bankroll, round(max(peak), 4) + 0.0 AS peak_bankroll, round(max((peak - bank) / peak), 6) + 0.0 AS max_drawdown_pct,
      count(*) AS n_bets, count(*) FILTER (WHERE {_WIN}) AS n_wins, count(*) FILTER (WHERE home_score <> away_score AND NOT {_WIN}) AS n_losses,
      round(sum(stake), 4) + 0.0 AS total_wagered, round(sum(profit), 4) + 0.0 AS total_profit, round(sum(profit) / sum(stake), 7) + 0.0 AS roi,
      round(avg(rk), 9) + 0.0 AS avg_kelly, round(avg(rev), 9) + 0.0 AS avg_ev_at_bet, 100.0::DOUBLE AS starting_bankroll,
      round(count(*) FILTER (WHERE %s) / count(*) FILTER (WHERE home_score <> away_score), 9) + 0.0 AS hit_rate, round(arg_max(bank, bet_idx) / 100 - 1, 6) + 0.0 AS bankroll_growth_pct,
      round(avg(stake), 6) + 0.0 AS avg_stake FROM bt""" % _WIN, "d_games", extra=bankroll_sql()))
def backtest_summary(spark, d):
    s = bets.backtest_summary(_history(spark, d))
    return s.select(rnd("final_bankroll", 4).alias("final_bankroll"), rnd("peak_bankroll", 4).alias("peak_bankroll"),
                    rnd("max_drawdown_pct", 6).alias("max_drawdown_pct"), *[big(c).alias(c) for c in ("n_bets", "n_wins", "n_losses")],
                    rnd("total_wagered", 4).alias("total_wagered"), rnd("total_profit", 4).alias("total_profit"), rnd("roi", 7).alias("roi"),
                    rnd("avg_kelly").alias("avg_kelly"), rnd("avg_ev_at_bet").alias("avg_ev_at_bet"), "starting_bankroll", rnd("hit_rate").alias("hit_rate"),
                    rnd("bankroll_growth_pct", 6).alias("bankroll_growth_pct"), rnd("avg_stake", 6).alias("avg_stake"))


@query("backtest_by_day", B.with_ctes(
    f"""SELECT game_date AS date, count(*) AS n_bets, round(sum(stake), 5) + 0.0 AS wagered, round(sum(profit), 5) + 0.0 AS profit,
      count(*) FILTER (WHERE {_WIN}) AS wins, round(arg_max(bank, bet_idx), 5) + 0.0 AS bankroll_end FROM bt GROUP BY 1""", "d_games", extra=bankroll_sql()))
def backtest_by_day(spark, d):
    df = bets.backtest_by_day(_history(spark, d))
    return df.select("date", "n_bets", rnd("wagered", 5).alias("wagered"), rnd("profit", 5).alias("profit"), "wins", rnd("bankroll_end", 5).alias("bankroll_end"))


_GRID = "(SELECT th, me FROM (VALUES (0.0), (0.02), (0.05)) a(th), (VALUES (0.05), (1e9)) b(me))"


@query("threshold_sweep", B.with_ctes(
    """SELECT th::DOUBLE AS ev_threshold, CASE WHEN me > 1000 THEN 'none' ELSE CAST(me AS VARCHAR) END AS max_edge, count(*) AS n_bets, count(*) FILTER (WHERE won) AS n_wins,
      round(sum(ln(1 + step)), 6) + 0.0 AS log_growth, round(avg(ev), 9) + 0.0 AS avg_ev_at_bet
    FROM w GROUP BY 1, 2""", "d_games", extra={
        **{k: v for k, v in bets_sql("").items() if k in ("s0", "s1", "s2", "s3")},
        "v": f"""SELECT *, CASE WHEN ev_home > ev_away AND ev_home > th AND abs(edge_home) <= me THEN 'home'
          WHEN ev_away > ev_home AND ev_away > th AND abs(edge_away) <= me THEN 'away' ELSE '' END AS r2 FROM s3, {_GRID}""",
        "w": """SELECT *, (r2 = 'home' AND home_score > away_score) OR (r2 = 'away' AND away_score > home_score) AS won, CASE r2 WHEN 'home' THEN ev_home ELSE ev_away END AS ev,
          CASE WHEN home_score = away_score THEN 0 WHEN (r2 = 'home' AND home_score > away_score) OR (r2 = 'away' AND away_score > home_score)
            THEN CASE r2 WHEN 'home' THEN kelly_home * (hd - 1) ELSE kelly_away * (ad - 1) END
            ELSE -CASE r2 WHEN 'home' THEN kelly_home ELSE kelly_away END END AS step FROM v WHERE r2 <> ''"""}))
def threshold_sweep(spark, d):
    slate = stage(bets.price_columns(slate_input(spark, d)), "slate")
    sweep = bets.threshold_sweep(slate, thresholds=(0.0, 0.02, 0.05), max_edges=(0.05, None))
    return sweep.select("ev_threshold", F.when(F.col("max_edge") > 1000, "none").otherwise(F.col("max_edge").cast("string")).alias("max_edge"),
                        "n_bets", "n_wins", rnd("log_growth", 6).alias("log_growth"), rnd("avg_ev_at_bet").alias("avg_ev_at_bet"))


# --- ledger ---------------------------------------------------------------------

NOW = "1999-01-01 00:00:00"


def first_ledger(spark, d):
    """Ledger after the first batch: games through 1998, some picks uncommitted, two years settled."""
    slate = bets.annotate_bets(slate_input(spark, d).where("game_date < DATE '1999-01-10'"), slate_keys=["game_date"])
    log = ledger.tickets(slate, "1998-01-01 00:00:00")
    return log.withColumn("recommended_side", F.when(F.col("game_id") % 4 != 0, F.col("recommended_side")))


_MERGE = {
    **bets_sql("game_date"),
    "old": "SELECT game_id, commence_time, CASE WHEN game_id % 4 <> 0 THEN rec END AS side, units FROM annotated WHERE rec <> '' AND game_date < DATE '1999-01-10'",
    "new": "SELECT game_id, rec AS side, units FROM annotated WHERE rec <> ''",
    "merged": f"""SELECT coalesce(o.game_id, n.game_id) AS game_id,
        CASE WHEN o.game_id IS NULL THEN 'inserted' WHEN n.game_id IS NULL THEN 'kept' WHEN TIMESTAMP '{NOW}' >= o.commence_time THEN 'skipped_post_commence'
          WHEN o.side IS NOT NULL THEN 'skipped_paper_locked' ELSE 'updated' END AS action, o.side AS os, n.side AS ns, o.units AS ou, n.units AS nu
      FROM old o FULL JOIN new n ON o.game_id = n.game_id""",
}


@query("ledger_merge", B.with_ctes(
    "SELECT game_id, action, CASE WHEN action IN ('inserted', 'updated') THEN ns ELSE os END AS recommended_side, round(CASE WHEN action IN ('inserted', 'updated') THEN nu ELSE ou END, 9) + 0.0 AS risk_units FROM merged",
    "d_games", extra=_MERGE))
def ledger_merge(spark, d):
    old = stage(first_ledger(spark, d), "ledger")
    slate = bets.annotate_bets(slate_input(spark, d), slate_keys=["game_date"])
    return ledger.merge_recommendations(old, slate, NOW).select("game_id", "action", "recommended_side", rnd("risk_units").alias("risk_units"))


@query("ledger_counts", B.with_ctes(
    """SELECT count(*) FILTER (WHERE action = 'inserted') AS inserted, count(*) FILTER (WHERE action = 'updated') AS updated,
      count(*) FILTER (WHERE action LIKE 'skipped%') AS skipped_locked, count(*) FILTER (WHERE action = 'skipped_post_commence') AS skipped_post_commence,
      count(*) FILTER (WHERE action = 'skipped_paper_locked') AS skipped_paper_locked FROM merged""", "d_games", extra=_MERGE))
def ledger_counts(spark, d):
    old = stage(first_ledger(spark, d), "ledger")
    slate = bets.annotate_bets(slate_input(spark, d), slate_keys=["game_date"])
    return ledger.ledger_counts(ledger.merge_recommendations(old, slate, NOW))


_SETTLED = {
    **bets_sql("game_date"),
    "log": f"""SELECT *, CASE WHEN home_score = away_score THEN 'push' WHEN {_WIN} THEN 'won' ELSE 'lost' END AS result, CASE WHEN rec = 'home' THEN hd ELSE ad END AS dec
      FROM annotated WHERE rec <> ''""",
    "settled": """SELECT *, CASE WHEN season_year >= 2001 THEN 'pending' ELSE result END AS outcome,
      CASE WHEN season_year >= 2001 THEN NULL WHEN result = 'push' THEN 0 WHEN result = 'won' THEN units * (dec - 1) ELSE -units END AS profit FROM log""",
}


def _settled(spark, d):
    slate = bets.annotate_bets(slate_input(spark, d), slate_keys=["game_date"])
    log = ledger.tickets(slate, NOW)
    g = B.games(spark, d)
    scores = ledger.final_scores(g.where("season_year < 1998"), g.where("season_year < 2001"))
    return ledger.reconcile_outcomes(log, scores)


@query("ledger_settle", B.with_ctes(
    "SELECT game_id, outcome, round(units, 9) + 0.0 AS risk_units, round(profit, 9) + 0.0 AS profit_units FROM settled", "d_games", extra=_SETTLED))
def ledger_settle(spark, d):
    return _settled(spark, d).select("game_id", "outcome", rnd("risk_units").alias("risk_units"), rnd("profit_units").alias("profit_units"))


@query("ledger_summary", B.with_ctes(
    """SELECT CAST(season_year AS BIGINT) AS season, count(*) AS n_bets, count(*) FILTER (WHERE outcome <> 'pending') AS n_settled, count(*) FILTER (WHERE outcome = 'pending') AS n_pending,
      count(*) FILTER (WHERE outcome = 'won') AS n_wins, round(count(*) FILTER (WHERE outcome = 'won') / greatest(count(*) FILTER (WHERE outcome IN ('won', 'lost')), 1), 9) + 0.0 AS hit_rate,
      round(coalesce(sum(profit), 0), 6) + 0.0 AS profit_units, round(coalesce(sum(profit), 0) / greatest(coalesce(sum(units) FILTER (WHERE outcome <> 'pending'), 0), 1e-9), 7) + 0.0 AS roi_per_unit,
      round(avg(rev), 9) + 0.0 AS avg_ev_at_rec FROM (SELECT *, year(commence_time) AS y FROM settled) GROUP BY season_year""", "d_games",
    extra={**{k: v.replace("season_year >= 2001", "season_year >= 2001") for k, v in _SETTLED.items()}}))
def ledger_summary(spark, d):
    log = _settled(spark, d).withColumn("season", F.year("game_date"))
    s = ledger.ledger_summary(log, ["season"])
    return s.select(big("season").alias("season"), *[big(c).alias(c) for c in ("n_bets", "n_settled", "n_pending", "n_wins")], rnd("hit_rate").alias("hit_rate"),
                    rnd("profit_units", 6).alias("profit_units"), rnd("roi_per_unit", 7).alias("roi_per_unit"), rnd("avg_ev_at_rec").alias("avg_ev_at_rec"))


@query("ledger_trajectory", B.with_ctes(
    """SELECT game_id, round(sum(coalesce(profit, 0)) OVER (ORDER BY commence_time, game_id), 6) + 0.0 AS cum_profit FROM settled WHERE outcome <> 'pending'""",
    "d_games", extra=_SETTLED))
def ledger_trajectory(spark, d):
    return ledger.cumulative_profit(stage(_settled(spark, d), "ledger")).select("game_id", rnd("cum_profit", 6).alias("cum_profit"))


@query("ledger_view_rows", B.with_ctes(
    """SELECT game_id, CASE WHEN outcome = 'pending' THEN away_name || ' (TBD) @ ' || home_name || ' (Arm)' ELSE away_name || ' @ ' || home_name END AS matchup, outcome
    FROM settled WHERE year(commence_time) = 2001""", "d_games", extra=_SETTLED))
def ledger_view_rows(spark, d):
    schedule = B.games(spark, d).select("game_id", F.lit(None).cast("string").alias("away_probable_pitcher_name"), F.lit("long arm").alias("home_probable_pitcher_name"))
    return ledger.ledger_view(_settled(spark, d), schedule, 2001)["rows"].select("game_id", "matchup", "outcome")


def quoted_slate(spark, d):
    """The slate with the quote table's team names, so closing lines can be matched."""
    s = slate_input(spark, d)
    return s.withColumn("home_name", F.concat("home_name", F.lit(" #"), F.col("game_id").cast("string")))


@query("ledger_clv", B.with_ctes(
    """SELECT game_id, round(CASE WHEN rec = 'home' THEN l.home_price_american ELSE l.away_price_american END, 6) + 0.0 AS closing_odds,
      round((CASE WHEN rec = 'home' THEN ch / (ch + ca) ELSE ca / (ch + ca) END - CASE WHEN rec = 'home' THEN hf ELSE af END) * 100, 7) + 0.0 AS clv_pp
    FROM log LEFT JOIN (SELECT *, 1 / """ + _dec("home_price_american") + " AS ch, 1 / " + _dec("away_price_american") + f""" AS ca FROM lines) l
      ON log.commence_time = l.commence_time AND log.home_name || ' #' || log.game_id = l.home_team AND log.away_name = l.away_team AND log.commence_time <= TIMESTAMP '{NOW}'""",
    "d_games", "d_quotes", extra={**_SETTLED, **lines_sql(0)}))
def ledger_clv(spark, d):
    slate = bets.annotate_bets(quoted_slate(spark, d), slate_keys=["game_date"])
    out = ledger.reconcile_clv(ledger.tickets(slate, NOW), B.quotes(spark, d), NOW)
    return out.select("game_id", rnd("closing_odds", 6).alias("closing_odds"), rnd("clv_pp", 7).alias("clv_pp"))


# --- contact formulas ---------------------------------------------------------------

@query("personal_park_factor", B.with_ctes(
    """SELECT batter, side AS bat_side, round(CASE WHEN p.bat_side IS NULL OR n = 0 THEN 1.0 ELSE (bb * 0.69 * index_bb / 100 + hbp * 0.72 + s * 0.88 * index_1b / 100 + d * 1.27 * index_2b / 100 + t * 1.62 * index_3b / 100 + h * 2.1 * index_hr / 100) / n END, 7) + 0.0 AS factor
    FROM (SELECT *, bb * 0.69 + hbp * 0.72 + s * 0.88 + d * 1.27 + t * 1.62 + h * 2.1 AS n FROM (SELECT player_id AS batter, sum(BB) AS bb, sum(HBP) AS hbp, sum(_1B) AS s, sum(_2B) AS d, sum(_3B) AS t, sum(HR) AS h FROM dc GROUP BY 1))
    CROSS JOIN (VALUES ('L'), ('R')) sides(side) LEFT JOIN d_park p ON batter // 100 = main_team_id AND bat_side = side""", "d_pitches", "d_park", extra={"dc": S.daily("d_pitches", "batter")}))
def personal_park_factor(spark, d):
    from tidemark.operators import counts

    n = counts.daily_counts(B.pitches(spark, d), "batter").groupBy("player_id").agg(*[F.sum(c).alias(c) for c in ("BB", "HBP", "_1B", "_2B", "_3B", "HR")])
    sides = n.withColumn("stand", F.explode(F.array(F.lit("L"), F.lit("R"))))
    df = sides.withColumn("venue", features.team_codes(F.floor(F.col("player_id") / 100))).join(
        features.park_lookup(B.park_factors(spark, d)), ["venue", "stand"], "left")
    events = {"BB": F.col("BB"), "HBP": F.col("HBP"), "1B": F.col("_1B"), "2B": F.col("_2B"), "3B": F.col("_3B"), "HR": F.col("HR")}
    factors = {e: F.col(f"park_{e}") for e in ("1B", "2B", "3B", "HR", "BB")}
    factor = contact.personal_park_factor(F.coalesce(F.col("park_found"), F.lit(False)), events, factors)
    return df.select(F.col("player_id").alias("batter"), F.col("stand").alias("bat_side"), rnd(factor, 7).alias("factor"))


@query("legacy_contact_formulas", """
    SELECT l_orderkey, l_partkey, round(4.5 * (g / t + (f + d) / t * 1.1), 9) + 0.0 AS parked, round(CAST(4.5 * (1 - 0.0011 * (l_linenumber + 2.0)) AS DOUBLE), 9) + 0.0 AS defended, count(*) AS n
    FROM (SELECT *, g + f + d AS t FROM (SELECT *, (0.6 * l_discount + 0.4 * 0.4) * 0.21 AS g, (0.6 * l_tax + 0.4 * 0.3) * 0.34 AS f, (0.6 * 0.2 + 0.4 * 0.2) * 0.685 AS d FROM lineitem))
    GROUP BY 1, 2, 3, 4""")
def legacy_contact_formulas(spark, d):
    l = B.table(spark, d, "lineitem")
    mix = contact.blend_contact_legacy({"GB": F.col("l_discount"), "FB": F.col("l_tax"), "LD": F.lit(0.2)}, {"GB": F.lit(0.4), "FB": F.lit(0.3), "LD": F.lit(0.2)})
    runs = F.lit(4.5)
    df = l.select("l_orderkey", "l_partkey", rnd(contact.park_adjust(runs, mix["GB"], mix["FB"], mix["LD"], F.lit(1.1))).alias("parked"),
                  rnd(contact.defense_adjust(runs, F.col("l_linenumber"), F.lit(2.0))).alias("defended"))
    return df.groupBy("l_orderkey", "l_partkey", "parked", "defended").agg(F.count(F.lit(1)).alias("n"))
