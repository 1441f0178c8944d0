"""Queries: run model, calibration and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.operators import calibrate, evaluate, reshape, ridge, scan
from tidemark.plans import bindings as B, slate as SL, sqlparts as S
from tidemark.plans.registry import big, epoch, query, rnd
from tidemark.session import scratch_path, stage


def _labelled(spark, d):
    """A probability and a label per game, from the order attributes."""
    o = B.table(spark, d, "orders")
    p = F.lit(0.2) + (F.col("o_custkey") % 61) / 100.0
    return o.select("o_orderkey", p.alias("p_home"), (F.col("o_totalprice") % 1000 < 150 + 700 * p).cast("int").alias("home_win"))


_LABELLED = """SELECT o_orderkey, 0.2::DOUBLE + (o_custkey % 61) / 100.0::DOUBLE AS p_home,
  CAST(o_totalprice % 1000 < 150 + 700 * (0.2::DOUBLE + (o_custkey % 61) / 100.0::DOUBLE) AS INT) AS home_win FROM orders"""


@query("regression_metrics", """
    SELECT l_returnflag, count(*) AS n, round(avg(abs(e)), 6) + 0.0 AS mae, round(sqrt(avg(e * e)), 6) + 0.0 AS rmse, round(1 - sum(e * e) / (var_pop(a) * count(*)), 7) + 0.0 AS r2, round(avg(e), 6) + 0.0 AS bias
    FROM (SELECT l_returnflag, l_quantity AS a, l_extendedprice / 1500 - l_quantity AS e FROM lineitem) GROUP BY 1""")
def regression_metrics(spark, d):
    l = B.table(spark, d, "lineitem").withColumn("p", F.col("l_extendedprice") / 1500)
    m = evaluate.regression_metrics(l, "l_quantity", "p", ["l_returnflag"])
    return m.select("l_returnflag", "n", rnd("mae", 6).alias("mae"), rnd("rmse", 6).alias("rmse"), rnd("r2", 7).alias("r2"), rnd("bias", 6).alias("bias"))


@query("classification_metrics", f"""
    SELECT count(*) AS n, round(avg((CAST(p_home > 0.5 AS INT) = home_win)::INT), 9) + 0.0 AS accuracy, round(avg(-(home_win * ln(p_home) + (1 - home_win) * ln(1 - p_home))), 9) + 0.0 AS log_loss,
      round(avg((p_home - home_win) * (p_home - home_win)), 9) + 0.0 AS brier, round(avg(home_win), 9) + 0.0 AS home_win_rate, round(avg(p_home), 9) + 0.0 AS mean_p_home FROM ({_LABELLED})""")
def classification_metrics(spark, d):
    m = evaluate.classification_metrics(_labelled(spark, d), "home_win", "p_home")
    return m.select("n", *[rnd(c).alias(c) for c in ("accuracy", "log_loss", "brier", "home_win_rate", "mean_p_home")])


def _edges(source: str, col: str, n: int) -> str:
    return f"SELECT list_sort(list_distinct([{', '.join(f'quantile_cont({col}, {i / n!r})' for i in range(n + 1))}])) AS e FROM {source}"


def _bucket(col: str) -> str:
    return f"greatest(len(list_filter(e, lambda x: x < {col})) - 1, 0)"


@query("calibration_table", f"""
    WITH s AS (SELECT p_home + o_orderkey * 1e-9::DOUBLE AS p, home_win FROM ({_LABELLED})), q AS ({_edges('s', 'p', 10)})
    SELECT CAST({_bucket('p')} AS BIGINT) AS bucket, count(*) AS n, round(avg(p), 3) + 0.0 AS p_mean, round(avg(home_win), 3) + 0.0 AS actual FROM s, q GROUP BY 1""")
def calibration_table(spark, d):
    df = _labelled(spark, d).withColumn("p", F.col("p_home") + F.col("o_orderkey") * 1e-9)
    t = evaluate.calibration_table(df, "p", "home_win")
    return t.select(big("bucket").alias("bucket"), "n", rnd("p_home_mean", 3).alias("p_mean"), rnd("actual_home_win", 3).alias("actual"))


@query("calibration_repeated_edges", f"""
    WITH s AS (SELECT floor(p_home * 5) AS p, home_win FROM ({_LABELLED})), q AS ({_edges('s', 'p', 10)})
    SELECT CAST({_bucket('p')} AS BIGINT) AS bucket, count(*) AS n, sum(home_win)::BIGINT AS wins FROM s, q GROUP BY 1""")
def calibration_repeated_edges(spark, d):
    df = _labelled(spark, d).withColumn("p", F.floor(F.col("p_home") * 5))
    t = scan.quantile_bucket(df, "p", 10).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("home_win").alias("wins"))
    return t.select(big("bucket").alias("bucket"), "n", "wins")


@query("stratify", f"""
    WITH s AS (SELECT l_extendedprice AS f, l_quantity AS t FROM lineitem), q AS ({_edges('s', 'f', 5)})
    SELECT CAST({_bucket('f')} AS BIGINT) AS bucket, round(min(f), 2) AS bucket_min, round(max(f), 2) AS bucket_max, count(*) AS n, round(avg(t), 2) + 0.0 AS mean_target FROM s, q GROUP BY 1""")
def stratify(spark, d):
    t = evaluate.stratify(B.table(spark, d, "lineitem"), "l_extendedprice", "l_quantity")
    return t.select(big("bucket").alias("bucket"), F.round("bucket_min", 2).alias("bucket_min"), F.round("bucket_max", 2).alias("bucket_max"), "n", rnd("mean_target", 2).alias("mean_target"))


_Q = (0.0, 0.1, 0.25, 0.5, 0.8, 1.0)


@query("exact_quantiles", """
    SELECT key, n, """ + ", ".join(f"round(quantile_cont(v, {p!r}), 6) + 0.0 AS q{i}" for i, p in enumerate(_Q)).replace("quantile_cont", "quantile_cont") + """
    FROM (SELECT key, v, count(*) OVER (PARTITION BY key) AS n FROM (SELECT 'price' AS key, l_extendedprice AS v FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem UNION ALL SELECT 'quantity', l_quantity FROM lineitem)) GROUP BY key, n""")
def exact_quantiles(spark, d):
    l = B.table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_quantity").alias("quantity"))
    q = scan.exact_quantiles(scan.melt(l, ["price", "discount", "quantity"]), _Q)
    return q.select("key", big("n").alias("n"), *[rnd(F.get("q", F.lit(i)), 6).alias(f"q{i}") for i in range(len(_Q))])


_SEL = (0.50, 0.55, 0.60, 0.75)


@query("selective_accuracy", " UNION ALL ".join(f"""
    SELECT {t}::DOUBLE AS threshold, count(*) FILTER (WHERE k) AS bets, round(count(*) FILTER (WHERE k) / count(*), 9) + 0.0 AS coverage,
      round(avg((CAST(p_home > 0.5 AS INT) = home_win)::INT) FILTER (WHERE k), 9) + 0.0 AS accuracy, round(avg(home_win) FILTER (WHERE k AND p_home > 0.5), 9) + 0.0 AS home_accuracy,
      round(avg(1 - home_win) FILTER (WHERE k AND p_home <= 0.5), 9) + 0.0 AS away_accuracy FROM (SELECT *, abs(p_home - 0.5::DOUBLE) >= {t}::DOUBLE - 0.5::DOUBLE AS k FROM ({_LABELLED})) HAVING count(*) FILTER (WHERE k) > 0""" for t in _SEL))
def selective_accuracy(spark, d):
    df = evaluate.selective_accuracy(_labelled(spark, d), "p_home", "home_win", _SEL)
    return df.select("threshold", "bets", *[rnd(c).alias(c) for c in ("coverage", "accuracy", "home_accuracy", "away_accuracy")])


@query("baseline_metrics", f"""
    SELECT count(*) AS n, round(avg(home_win), 9) + 0.0 AS always_home_accuracy, round(avg(home_win) * (1 - avg(home_win)), 9) + 0.0 AS constant_brier,
      round(avg((CAST(h < a AS INT) = home_win)::INT) FILTER (WHERE h IS NOT NULL), 9) + 0.0 AS lower_rate_accuracy, count(h) AS lower_rate_n
    FROM (SELECT *, CASE WHEN o_orderkey % 10 <> 3 THEN (1 - p_home) END AS h, 0.55::DOUBLE AS a FROM ({_LABELLED}))""")
def baseline_metrics(spark, d):
    df = _labelled(spark, d).withColumns({"h": F.when(F.col("o_orderkey") % 10 != 3, 1 - F.col("p_home")), "a": F.lit(0.55)})
    m = evaluate.baseline_metrics(df, "home_win", "h", "a")
    return m.select("n", *[rnd(c).alias(c) for c in ("always_home_accuracy", "constant_brier", "lower_rate_accuracy")], "lower_rate_n")


# --- ridge: two standardised features have a closed form -------------------------------

def _design(spark, d):
    return B.table(spark, d, "lineitem").select(
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("x1"), (F.col("l_discount") + F.col("l_tax")).alias("x2"),
        (F.col("l_extendedprice") / 1000).alias("runs"), "l_orderkey")


_DESIGN = """base AS (SELECT CASE WHEN l_linenumber <> 3 THEN l_quantity END AS x1, l_discount + l_tax AS x2, l_extendedprice / 1000 AS y FROM lineitem),
  med AS (SELECT median(x1) AS m1, median(x2) AS m2 FROM base), z AS (SELECT coalesce(x1, m1) AS x1, coalesce(x2, m2) AS x2, y FROM base, med),
  m AS (SELECT count(*) AS n, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, avg(x1) AS u1, avg(x2) AS u2, corr(x1, x2) AS r, covar_pop(x1, y) / stddev_pop(x1) AS b1, covar_pop(x2, y) / stddev_pop(x2) AS b2, avg(y) AS yb FROM z),
  w AS (SELECT *, ((n + 1) * n * b1 - n * r * n * b2) / ((n + 1) * (n + 1) - n * r * n * r) AS w1, ((n + 1) * n * b2 - n * r * n * b1) / ((n + 1) * (n + 1) - n * r * n * r) AS w2 FROM m)"""


@query("ridge_coefficients", f"""WITH {_DESIGN}
    SELECT 'x1' AS feature, round(m1, 6) + 0.0 AS impute, round(u1, 6) + 0.0 AS mean, round(s1, 6) + 0.0 AS scale, round(w1, 6) + 0.0 AS coef, round(yb, 6) + 0.0 AS intercept, n AS train_n FROM w, med
    UNION ALL SELECT 'x2', round(m2, 6) + 0.0, round(u2, 6) + 0.0, round(s2, 6) + 0.0, round(w2, 6) + 0.0, round(yb, 6) + 0.0, n FROM w, med""")
def ridge_coefficients(spark, d):
    m = ridge.fit_ridge(_design(spark, d), ["x1", "x2"])
    return m.select("feature", *[rnd(c, 6).alias(c) for c in ("impute", "mean", "scale", "coef", "intercept")], "train_n")


@query("ridge_predict", f"""WITH {_DESIGN}
    SELECT l_orderkey, round(sum(p), 4) + 0.0 AS pred FROM (SELECT l_orderkey, yb + (coalesce(CASE WHEN l_linenumber <> 3 THEN l_quantity END, m1) - u1) / s1 * w1 + (l_discount + l_tax - u2) / s2 * w2 AS p
      FROM lineitem, w, med) GROUP BY 1""")
def ridge_predict(spark, d):
    base = _design(spark, d)
    scored = ridge.score(base, ridge.fit_ridge(base, ["x1", "x2"]), "p")
    return scored.groupBy("l_orderkey").agg(F.sum("p").alias("p")).select("l_orderkey", rnd("p", 4).alias("pred"))


@query("platt_moments", f"""
    SELECT count(*) AS n, round(avg(home_win), 6) + 0.0 AS mean_calibrated, round(avg(p_home * home_win), 6) + 0.0 AS mean_p_calibrated FROM ({_LABELLED})""")
def platt_moments(spark, d):
    """The fitted curve must reproduce the label's mean and its product with the input."""
    df = _labelled(spark, d)
    out = calibrate.apply_platt(df, calibrate.fit_platt(df, "p_home", "home_win"), "p_home")
    return out.agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("p_calibrated"), 6).alias("mean_calibrated"),
                   rnd(F.avg(F.col("p_home") * F.col("p_calibrated")), 6).alias("mean_p_calibrated"))


# The normal equations of the likelihood, twelve Newton steps from zero.
_PLATT = f"""WITH RECURSIVE d AS (SELECT p_home AS p, home_win AS y, count(*) AS w FROM ({_LABELLED}) GROUP BY 1, 2),
    steps AS (SELECT 0 AS k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL
      SELECT k + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
      FROM (SELECT k, a, b, sum(w * (q - y) * p) AS ga, sum(w * (q - y)) AS gb, sum(w * q * (1 - q) * p * p) AS haa, sum(w * q * (1 - q) * p) AS hab, sum(w * q * (1 - q)) AS hbb
        FROM (SELECT k, a, b, p, y, w, 1 / (1 + exp(-(a * p + b))) AS q FROM steps, d WHERE k < 12) GROUP BY k, a, b))"""


@query("platt_parameters", _PLATT + """
    SELECT round(a, 6) + 0.0 AS slope, round(b, 6) + 0.0 AS intercept, round(-a, 6) + 0.0 AS "A", round(-b, 6) + 0.0 AS "B", t.n AS train_n, round(t.p, 9) + 0.0 AS train_p_mean, round(t.y, 9) + 0.0 AS train_y_rate
    FROM steps, (SELECT CAST(sum(w) AS BIGINT) AS n, sum(w * p) / sum(w) AS p, sum(w * y) / sum(w) AS y FROM d) t WHERE k = 12""")
def platt_parameters(spark, d):
    fit = calibrate.fit_platt(_labelled(spark, d), "p_home", "home_win")
    return fit.select(*[rnd(c, 6).alias(c) for c in ("slope", "intercept", "A", "B")], "train_n", *[rnd(c).alias(c) for c in ("train_p_mean", "train_y_rate")])


_SHIFT = 0.00003
# The fit is the slope of the lower hull of (weight so far, wins so far): a point is a corner if every slope before it is below every one after it.
_HULL = f"""WITH s AS (SELECT round(p_home + (o_orderkey % 97) * 1e-4::DOUBLE, 6) AS p, sum(home_win)::BIGINT AS y, count(*) AS w FROM ({_LABELLED}) GROUP BY 1),
    c AS (SELECT p, row_number() OVER o AS k, (sum(w) OVER o)::BIGINT AS w, (sum(y) OVER o)::BIGINT AS y FROM s WINDOW o AS (ORDER BY p) UNION ALL SELECT NULL, 0, 0, 0),
    corner AS (SELECT a.k, a.p, a.w, a.y FROM c a JOIN c b ON a.k <> b.k GROUP BY ALL
      HAVING coalesce(max((a.y - b.y) / (a.w - b.w)::DOUBLE) FILTER (WHERE b.k < a.k), -1) < coalesce(min((a.y - b.y) / (a.w - b.w)::DOUBLE) FILTER (WHERE b.k > a.k), 9)),
    spans AS (SELECT lag(k) OVER (ORDER BY k) AS before, k, p AS high, (y - lag(y) OVER (ORDER BY k)) / (w - lag(w) OVER (ORDER BY k))::DOUBLE AS v FROM corner),
    blocks AS (SELECT c.p AS low, high, v, lead(c.p) OVER (ORDER BY spans.k) AS next_low, lead(v) OVER (ORDER BY spans.k) AS next_v FROM spans JOIN c ON c.k = before + 1)"""


@query("isotonic", _HULL + f"""
    SELECT round(s.p, 6) + 0.0 AS p, round(least(greatest(a.v, 1e-9), 1 - 1e-9), 7) + 0.0 AS p_calibrated,
      round(least(greatest(CASE WHEN s.p + {_SHIFT} <= b.high OR b.next_low IS NULL THEN b.v ELSE b.v + (s.p + {_SHIFT} - b.high) / (b.next_low - b.high) * (b.next_v - b.v) END, 1e-9), 1 - 1e-9), 7) + 0.0 AS between_calibrated
    FROM s ASOF JOIN blocks a ON s.p >= a.low ASOF JOIN blocks b ON s.p + {_SHIFT} >= b.low""")
def isotonic(spark, d):
    """Thousands of different scores, asked for themselves and for places between them."""
    df = _labelled(spark, d).withColumn("p", F.round(F.col("p_home") + (F.col("o_orderkey") % 97) * F.lit(1e-4), 6))
    fit = stage(calibrate.fit_isotonic(df, "p", "home_win"), "isotonic-fit")
    asked = df.select("p", (F.col("p") + _SHIFT).alias("between")).distinct()
    out = calibrate.apply_isotonic(calibrate.apply_isotonic(asked, fit, "p"), fit, "between", "between_calibrated")
    return out.select(rnd("p", 6).alias("p"), rnd("p_calibrated", 7).alias("p_calibrated"), rnd("between_calibrated", 7).alias("between_calibrated"))


# --- games with simple features, through the model to a priced slate ---------------------

def featured_games(spark, d):
    """Games carrying every feature of the baseline set (cheap stand-ins per team and game)."""
    g = B.games(spark, d)
    feats = {}
    for side, other in (("home", "away"), ("away", "home")):
        t, s = F.col(f"{side}_id"), F.col(f"{side}_score")
        feats |= {
            f"{side}_off_xwOBA": 0.28 + (t % 13) / 200.0 + s / 300.0, f"{side}_off_Barrel_pct": 0.05 + (F.col("game_id") % 17) / 400.0,
            f"{side}_off_HR_pct": 0.02 + (t % 7) / 300.0, f"{side}_off_BB_pct": F.when(F.col("game_id") % 11 != 0, 0.07 + (t % 5) / 200.0),
            f"{side}_sp_SIERA": 3.2 + (F.col(f"{other}_score") % 5) / 4.0, f"{side}_sp_xwOBA": 0.29 + (F.col("game_id") % 23) / 500.0,
            f"{side}_sp_Barrel_pct": 0.06 + (t % 9) / 400.0,
        }
    return g.withColumns(feats)


# Two features, so that SQL can restate a fit; a slate is scored with a parameter table that is given.
PAIR = ("off_HR_pct", "opp_sp_SIERA")
_GIVEN = [("given", PAIR[0], 0, 0.03, 0.03, 0.01, 0.25, 4.5, 0, 4.5, 3.0), ("given", PAIR[1], 1, 3.7, 3.7, 0.5, 0.6, 4.5, 0, 4.5, 3.0)]
_STACKED = """
    SELECT game_id, season_year, 'home' AS side, home_score AS y, 0.02::DOUBLE + (home_id % 7) / 300.0::DOUBLE AS x1, 3.2::DOUBLE + (home_score % 5) / 4.0::DOUBLE AS x2 FROM d_games
    UNION ALL SELECT game_id, season_year, 'away', away_score, 0.02::DOUBLE + (away_id % 7) / 300.0::DOUBLE, 3.2::DOUBLE + (away_score % 5) / 4.0::DOUBLE FROM d_games"""
_FITS = """
    SELECT *, ((n + 1) * n * b1 - n * r * n * b2) / ((n + 1) * (n + 1) - n * r * n * r) AS w1, ((n + 1) * n * b2 - n * r * n * b1) / ((n + 1) * (n + 1) - n * r * n * r) AS w2
    FROM (SELECT season_year, count(*) AS n, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, avg(x1) AS u1, avg(x2) AS u2, corr(x1, x2) AS r,
            covar_pop(x1, y) / stddev_pop(x1) AS b1, covar_pop(x2, y) / stddev_pop(x2) AS b2, avg(y) AS yb FROM stacked GROUP BY 1)"""


def _win(h: str, a: str) -> str:
    return f"pow(greatest({h}, 1e-9), {K.PYTHAG_EXPONENT}) / (pow(greatest({h}, 1e-9), {K.PYTHAG_EXPONENT}) + pow(greatest({a}, 1e-9), {K.PYTHAG_EXPONENT}))"


def _slate_ctes() -> dict[str, str]:
    from tidemark.plans.checks_market import bets_sql

    parts = bets_sql("game_date")
    return {
        "stacked": _STACKED,
        "runs": f"""SELECT game_id, max(p) FILTER (WHERE side = 'home') + {K.HOME_RUNS_BONUS} AS hr, max(p) FILTER (WHERE side = 'away') AS ar
          FROM (SELECT *, 4.5 + (x1 - 0.03) / 0.01 * 0.25 + (x2 - 3.7) / 0.5 * 0.6 AS p FROM stacked) GROUP BY 1""",
        "lines": f"""SELECT *, row_number() OVER (PARTITION BY ny, home_id, away_id ORDER BY commence_time DESC, hp DESC) AS rn
          FROM (SELECT *, CAST(timezone('America/New_York', timezone('UTC', commence_time)) AS DATE) AS ny FROM ({parts['s0']}))""",
        **parts,
        "s0": f"""SELECT g.game_id, g.game_date, l.commence_time, g.home_name, g.away_name, hr, ar, hp, ap, {_win('hr', 'ar')} AS p_home
          FROM d_games g JOIN runs USING (game_id) JOIN lines l ON rn = 1 AND ny = g.game_date AND l.home_id = g.home_id AND l.away_id = g.away_id""",
    }


def priced_slate(spark, d):
    """All games, scored with the given parameters, with the line of their New York date and teams, and the bets on them."""
    from tidemark.plans.checks_market import slate_input
    from tidemark.schemas import MODEL

    model = spark.createDataFrame(_GIVEN, MODEL)
    lines = slate_input(spark, d).select("commence_time", "snapshot_ts", "home_id", "away_id", "home_price_american", "away_price_american", "home_book", "away_book")
    return SL.predict_slate(stage(featured_games(spark, d).drop("commence_time"), "games"), model, stage(lines, "lines"), slate_keys=["game_date"])


_PRICED = {"hr": "home_runs_pred", "ar": "away_runs_pred", "p_home": "p_home", "hp": "home_price_american", "ap": "away_price_american", "hd": "home_decimal",
           "hf": "home_fair_p", "vig": "vig", "edge_home": "edge_home", "edge_away": "edge_away", "ev_home": "ev_home", "ev_away": "ev_away",
           "kelly_home": "kelly_home", "kelly_away": "kelly_away", "rev": "recommended_ev", "rk": "recommended_kelly",
           "pre": "recommended_kelly_pre_daily", "ref": "risk_ref_kelly", "units": "risk_units"}


@query("predict_slate", B.with_ctes(
    "SELECT game_id, CAST(epoch(commence_time) AS BIGINT) AS start_s, rec AS recommended, " + ", ".join(
        f"round(CAST({k} AS DOUBLE), 8) + 0.0 AS {n}" for k, n in _PRICED.items()) + " FROM annotated", "d_games", extra=_slate_ctes()))
def predict_slate(spark, d):
    return priced_slate(spark, d).select("game_id", epoch("commence_time").alias("start_s"), "recommended", *[rnd(n, 8).alias(n) for n in _PRICED.values()])


@query("slate_report", B.with_ctes(
    f"""SELECT 'bets' AS report, row_number() OVER (ORDER BY round(rev, {SL.EV_DIGITS}) DESC, game_id) AS place, game_id, away_name || ' @ ' || home_name AS game, upper(rec) AS verdict,
      round(CASE rec WHEN 'home' THEN p_home ELSE 1 - p_home END, 8) + 0.0 AS p FROM annotated WHERE rec <> ''
    UNION ALL SELECT 'slate', row_number() OVER (ORDER BY commence_time, game_id), game_id, away_name || ' @ ' || home_name,
      CASE WHEN rec <> '' THEN 'bet ' || upper(rec) ELSE 'no bet' END, round(p_home, 8) + 0.0 FROM annotated""", "d_games", extra=_slate_ctes()))
def slate_report(spark, d):
    """Both tables of the report, each row with its place in the table's order."""
    from tidemark.operators import scan

    chosen, full = SL.slate_report(stage(priced_slate(spark, d), "slate"))

    def placed(df, order):
        one = df.withColumn("one", F.lit(1))
        return scan.running(scan.with_ranges(one, order), {"place": ("sum", "one")}, order)

    bets = placed(chosen.withColumn("first", -F.round("ev", SL.EV_DIGITS)), ["first", "game_id"]).select(
        F.lit("bets").alias("report"), big("place").alias("place"), "game_id", "game", F.col("side").alias("verdict"), rnd("model_p", 8).alias("p"))
    slate = placed(full, ["commence_time", "game_id"]).select(
        F.lit("slate").alias("report"), big("place").alias("place"), "game_id", "game", "verdict", rnd("p_home", 8).alias("p"))
    return bets.unionByName(slate)


@query("ablation", B.with_ctes(
    """SELECT CAST(season_year AS VARCHAR) AS split, 'pair' AS feature_set, CAST(2 AS BIGINT) AS n_feat, CAST(any_value(fit_n) AS BIGINT) AS train_n, count(*) AS n,
      round(avg(abs(h - hs)) / 2 + avg(abs(a - aws)) / 2, 6) + 0.0 AS mae, round(avg(((p > 0.5) = (hs > aws))::INT), 6) + 0.0 AS accuracy,
      round(avg(-ln(CASE WHEN hs > aws THEN p ELSE 1 - p END)), 6) + 0.0 AS log_loss, round(avg(pow(p - (hs > aws)::INT, 2)), 6) + 0.0 AS brier,
      round(avg(p), 6) + 0.0 AS mean_p_home, round(avg((hs > aws)::INT), 6) + 0.0 AS home_win_rate
    FROM scored GROUP BY season_year""", "d_games", extra={
        "stacked": _STACKED, "fits": _FITS, "last": "SELECT max(season_year) AS top FROM d_games",
        "sides": f"""SELECT f.season_year, f.n AS fit_n, game_id, side, y, yb + (x1 - u1) / s1 * w1 + (x2 - u2) / s2 * w2 + CASE WHEN side = 'home' THEN {K.HOME_RUNS_BONUS} ELSE 0 END AS pred
          FROM stacked s JOIN last ON s.season_year = top JOIN fits f ON f.season_year < top""",
        "folded": """SELECT season_year, fit_n, game_id, max(y) FILTER (WHERE side = 'home') AS hs, max(y) FILTER (WHERE side = 'away') AS aws,
          max(pred) FILTER (WHERE side = 'home') AS h, max(pred) FILTER (WHERE side = 'away') AS a FROM sides GROUP BY 1, 2, 3""",
        "scored": f"SELECT *, {_win('h', 'a')} AS p FROM folded"}))
def ablation(spark, d):
    """One model for each season before the last, all scored on the last."""
    games = stage(featured_games(spark, d), "games")
    seasons = sorted(r[0] for r in games.select("season_year").distinct().collect())
    train = {str(y): games.where(F.col("season_year") == y) for y in seasons[:-1]}
    out = SL.ablation(train, games.where(F.col("season_year") == seasons[-1]), {"pair": PAIR})
    return out.select("split", "feature_set", big("n_feat").alias("n_feat"), big("train_n").alias("train_n"), "n", *[rnd(c, 6).alias(c) for c in ("mae", "accuracy", "log_loss", "brier", "mean_p_home", "home_win_rate")])


_FORMULAS = {
    "off_xwOBA": "0.28 + (own % 13) / 200.0 + y / 300.0", "off_Barrel_pct": "0.05 + (game_id % 17) / 400.0", "off_HR_pct": "0.02 + (own % 7) / 300.0",
    "off_BB_pct": "CASE WHEN game_id % 11 <> 0 THEN 0.07 + (own % 5) / 200.0 END", "opp_sp_SIERA": "3.2 + (y % 5) / 4.0",
    "opp_sp_xwOBA": "0.29 + (game_id % 23) / 500.0", "opp_sp_Barrel_pct": "0.06 + (opp % 9) / 400.0", "is_home": "CASE WHEN side = 'home' THEN 1 ELSE 0 END"}
_SETS = {"pair": PAIR, "baseline": K.FEATURES_BASELINE}


def _fit_residuals(stacked, models):
    """``sum(z (y - fitted)) - alpha w`` per feature and game row: zero for the minimiser of the ridge loss and for nothing else.

    ``sum(z miss)`` follows from sums of ``miss x`` and of ``miss`` over the rows without ``x``, so the rows meet no parameter table:
    they are reduced to one row per model, which is joined.
    """
    union = list(dict.fromkeys(f for s in _SETS.values() for f in s))
    scored = ridge.score_models(stacked, models).where(F.col("season_year") <= F.col("through")).withColumn("miss", F.col("runs") - F.col("runs_pred"))
    sums = scored.groupBy("through", "feature_set").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("miss").alias("all"),
        *[F.sum(F.col("miss") * F.col(f).cast("double")).alias(f"x_{f}") for f in union],
        *[F.sum(F.when(F.col(f).isNull(), F.col("miss"))).alias(f"no_{f}") for f in union])
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(f"x_{f}", F.lit(0.0)).alias("x"), F.coalesce(f"no_{f}", F.lit(0.0)).alias("no"))
                                for f in union])).alias("f")
    met = sums.select("through", "feature_set", "rows", "all", parts).select("*", "f.*").drop("f").join(models, ["through", "feature_set", "feature"])
    missed = (F.col("x") + F.coalesce("impute", F.lit(0.0)) * F.col("no") - F.col("mean") * F.col("all")) / F.col("scale")
    return met.select("through", "feature_set", "feature", ((missed - K.RIDGE_ALPHA * F.col("coef")) / F.col("rows")).alias("residual"))


@query("window_models", B.with_ctes(
    """SELECT through, feature_set, feature, n AS train_n, round(m, 6) + 0.0 AS impute, round(u, 8) + 0.0 AS mean, round(s, 8) + 0.0 AS scale, 0.0::DOUBLE AS residual
    FROM (SELECT through, feature, any_value(m) AS m, count(*) AS n, avg(coalesce(x, m)) AS u, stddev_pop(coalesce(x, m)) AS s FROM filled GROUP BY 1, 2) JOIN sets USING (feature)""",
    "d_games", extra={
        "halves": """SELECT game_id, season_year, 'home' AS side, home_id AS own, away_id AS opp, home_score AS y FROM d_games
          UNION ALL SELECT game_id, season_year, 'away', away_id, home_id, away_score FROM d_games""",
        "long": " UNION ALL ".join(f"SELECT season_year, '{f}' AS feature, CAST({e} AS DOUBLE) AS x FROM halves" for f, e in _FORMULAS.items()),
        "sets": " UNION ALL ".join(f"SELECT '{s}' AS feature_set, '{f}' AS feature" for s, fs in _SETS.items() for f in fs),
        "seen": "SELECT t.season_year AS through, feature, x FROM (SELECT DISTINCT season_year FROM d_games) t JOIN long ON long.season_year <= t.season_year",
        "filled": "SELECT *, median(x) OVER (PARTITION BY through, feature) AS m FROM seen"}))
def window_models(spark, d):
    """The production baseline and a small set, fitted on every expanding window; each fit is checked by its normal equations on the rows."""
    stacked = stage(reshape.stack_sides(featured_games(spark, d)), "stacked")
    models = ridge.fit_windows(stacked, _SETS)
    out = models.join(_fit_residuals(stacked, models), ["through", "feature_set", "feature"])
    return out.select("through", "feature_set", "feature", "train_n", *[rnd(c, n).alias(c) for c, n in (("impute", 6), ("mean", 8), ("scale", 8), ("residual", 6))])


@query("runs_model", B.with_ctes(
    """SELECT feature, count(*) AS train_n, round(any_value(m), 6) + 0.0 AS impute, round(avg(coalesce(x, m)), 8) + 0.0 AS mean, round(stddev_pop(coalesce(x, m)), 8) + 0.0 AS scale, 0.0::DOUBLE AS residual
    FROM (SELECT feature, x, median(x) OVER (PARTITION BY feature) AS m FROM long) GROUP BY 1""", "d_games", extra={
        "halves": """SELECT game_id, 'home' AS side, home_id AS own, away_id AS opp, home_score AS y FROM d_games UNION ALL SELECT game_id, 'away', away_id, home_id, away_score FROM d_games""",
        "long": " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({_FORMULAS[f]} AS DOUBLE) AS x FROM halves" for f in K.FEATURES_BASELINE)}))
def runs_model(spark, d):
    """The production baseline fitted on both sides of all games, checked by its normal equations."""
    games = stage(featured_games(spark, d), "games")
    model = ridge.train_runs_model(games, K.FEATURES_BASELINE)
    last = games.agg(F.max("season_year")).first()[0]
    as_window = model.drop("feature_set").withColumns({"through": F.lit(last).cast("int"), "feature_set": F.lit("baseline")})
    residuals = _fit_residuals(reshape.stack_sides(games), as_window)
    out = as_window.join(residuals, ["through", "feature_set", "feature"])
    return out.select("feature", "train_n", *[rnd(c, n).alias(c) for c, n in (("impute", 6), ("mean", 8), ("scale", 8), ("residual", 6))])


@query("expanding_ablation", B.with_ctes(
    """SELECT through, feature_set, CAST(CASE feature_set WHEN 'pair' THEN 2 ELSE 1 END AS BIGINT) AS n_feat, CAST(any_value(fit_n) AS BIGINT) AS train_n, count(*) AS n,
      round(avg(abs(h - hs)) / 2 + avg(abs(a - aws)) / 2, 6) + 0.0 AS mae, round(avg(((p > 0.5) = (hs > aws))::INT), 6) + 0.0 AS accuracy,
      round(avg(-ln(CASE WHEN hs > aws THEN p ELSE 1 - p END)), 6) + 0.0 AS log_loss, round(avg(pow(p - (hs > aws)::INT, 2)), 6) + 0.0 AS brier,
      round(avg(p), 6) + 0.0 AS mean_p_home, round(avg((hs > aws)::INT), 6) + 0.0 AS home_win_rate
    FROM scored GROUP BY 1, 2""", "d_games", extra={
        "all_sides": _STACKED, "last": "SELECT max(season_year) AS top FROM d_games",
        "stacked": """SELECT t.season_year, y, x1, x2 FROM (SELECT DISTINCT season_year FROM d_games) t JOIN all_sides s ON s.season_year <= t.season_year""",
        "fits": _FITS,
        "sides": f"""SELECT f.season_year AS through, m.feature_set, f.n AS fit_n, game_id, side, y, yb + CASE m.feature_set WHEN 'pair' THEN (x1 - u1) / s1 * w1 + (x2 - u2) / s2 * w2
            ELSE (x2 - u2) / s2 * n * b2 / (n + 1) END + CASE WHEN side = 'home' THEN {K.HOME_RUNS_BONUS} ELSE 0 END AS pred
          FROM all_sides s JOIN last ON s.season_year = top JOIN fits f ON f.season_year < top, (SELECT unnest(['pair', 'single']) AS feature_set) m""",
        "folded": """SELECT through, feature_set, fit_n, game_id, max(y) FILTER (WHERE side = 'home') AS hs, max(y) FILTER (WHERE side = 'away') AS aws,
          max(pred) FILTER (WHERE side = 'home') AS h, max(pred) FILTER (WHERE side = 'away') AS a FROM sides GROUP BY 1, 2, 3, 4""",
        "scored": f"SELECT *, {_win('h', 'a')} AS p FROM folded"}))
def expanding_ablation(spark, d):
    """Two feature sets on every expanding window before the last season, scored on that season; one pass for all fits."""
    games = stage(featured_games(spark, d), "games")
    last = games.agg(F.max("season_year")).first()[0]
    out = SL.expanding_ablation(games.where(F.col("season_year") < last), games.where(F.col("season_year") == last), {"pair": PAIR, "single": PAIR[1:]})
    return out.select("through", "feature_set", big("n_feat").alias("n_feat"), big("train_n").alias("train_n"), "n",
                      *[rnd(c, 6).alias(c) for c in ("mae", "accuracy", "log_loss", "brier", "mean_p_home", "home_win_rate")])


@query("coefficient_table", f"""WITH {_DESIGN}
    SELECT feature, round(coef, 6) + 0.0 AS coef_std, row_number() OVER (ORDER BY abs(coef) DESC, feature) AS place FROM (
      SELECT 'x1' AS feature, w1 AS coef FROM w UNION ALL SELECT 'x2', w2 FROM w)""")
def coefficient_table(spark, d):
    table = ridge.coefficient_table(ridge.fit_ridge(_design(spark, d), ["x1", "x2"]))
    ordered = table.select("feature_set", F.struct(F.abs("coef_std").alias("size"), "feature", "coef_std").alias("row"))
    # One row per feature of a model, so the list is short; it keeps the order of the table.
    listed = ordered.groupBy("feature_set").agg(F.reverse(F.array_sort(F.collect_list("row"))).alias("rows"))
    return listed.select(F.posexplode("rows").alias("at", "row")).select("row.feature", rnd("row.coef_std", 6).alias("coef_std"), big(F.col("at") + 1).alias("place"))


@query("stored_model", f"""WITH {_DESIGN}
    SELECT 'x1' AS feature, 0 AS position, round(w1, 6) + 0.0 AS coef, round(yb, 6) + 0.0 AS intercept FROM w UNION ALL SELECT 'x2', 1, round(w2, 6) + 0.0, round(yb, 6) + 0.0 FROM w""")
def stored_model(spark, d):
    path = scratch_path(spark, "model")
    ridge.save_model(ridge.fit_ridge(_design(spark, d), ["x1", "x2"]), path)
    return ridge.load_model(spark, path).select("feature", "position", rnd("coef", 6).alias("coef"), rnd("intercept", 6).alias("intercept"))
