"""Queries: Structured Streaming jobs drained over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.plans import bindings as B
from tidemark.plans.registry import epoch, query, rnd
from tidemark.session import scratch_path, stage
from tidemark.streaming import jobs


def _drain(spark, stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    sink = scratch_path(spark, label)
    jobs.run_available(stream, sink, scratch_path(spark, f"{label}-checkpoint"), mode)
    return spark.read.schema(stream.schema).parquet(sink)


def _restage(spark, df: DataFrame, label: str) -> DataFrame:
    """Write a derived table and stream its files."""
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


STEPS = 4


def _steps(spark, df: DataFrame, ts: str, label: str, closing: DataFrame | None = None) -> DataFrame:
    """Write a derived table in steps of event time and stream it step by step; ``closing`` rows come last.

    The borders are quantiles of ``ts``; each step is one micro-batch of as many files as there are shuffle partitions.
    """
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = stage(df, label)
    seconds = F.unix_micros(ts) / 1e6
    borders = df.select(seconds.alias("s")).approxQuantile("s", [i / STEPS for i in range(1, STEPS)], 0.01)
    step = sum((seconds > x).cast("int") for x in borders) if borders else F.lit(0)
    path = scratch_path(spark, label)
    parts = [df.where(step == i) for i in range(STEPS)] + ([closing] if closing is not None else [])
    for part in parts:  # the files of a step are newer than those before
        part.select(*df.columns).repartition(width).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", width).parquet(path)


def _closed_events(spark, d) -> DataFrame:
    """Events in steps, then one row from years later, behind which all windows are closed."""
    ev = B.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = ev.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 5 YEARS")).alias("ts"))
    end = last.select(*[F.col("ts") if c == "ts" else F.lit(-1).cast("long").alias(c) if c == "user_id" else F.lit(None).cast(t).alias(c)
                        for c, t in ev.dtypes])
    return _steps(spark, ev, "ts", "events", end)


@query("stream_daily_counts", """
    SELECT user_id, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day_s, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS clicks, round(sum(value), 4) + 0.0 AS value
    FROM events GROUP BY 1, 2""")
def stream_daily_counts(spark, d):
    aggs = {"n": F.count(F.lit(1)), "clicks": F.count_if(F.col("event_type") == "click"), "value": F.sum("value")}
    out = _drain(spark, jobs.stream_daily_counts(_closed_events(spark, d), ["user_id"], "ts", aggs, delay="1 day"), "daily")
    return out.where("user_id >= 0").select("user_id", epoch("window_start").alias("day_s"), "n", "clicks", rnd("value", 4).alias("value"))


@query("stream_trailing_counts", """
    SELECT event_type, CAST(epoch(w) AS BIGINT) AS window_s, count(*) AS n FROM (SELECT event_type, unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS w FROM events)
    GROUP BY 1, 2""")
def stream_trailing_counts(spark, d):
    stream = jobs.stream_daily_counts(_closed_events(spark, d), ["event_type"], "ts", {"n": F.count(F.lit(1))}, delay="1 day", window="7 days", slide="1 day")
    return _drain(spark, stream, "trailing").where("event_type IS NOT NULL").select("event_type", epoch("window_start").alias("window_s"), "n")


@query("stream_dedupe_append", "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
def stream_dedupe_append(spark, d):
    ev = B.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("day", F.to_date("ts"))
    stream = jobs.stream_dedupe_append(_steps(spark, ev, "ts", "events"), ["user_id", "event_type", "day"], "ts", "2 days")
    return _drain(spark, stream, "dedupe").select("user_id", "event_type", "day")


@query("stream_latest_line", B.with_ctes(
    """SELECT CAST(epoch(commence_time) AS BIGINT) AS start_s, home_team, away_team, CAST(epoch(snapshot_ts) AS BIGINT) AS snapshot_s, home_price_american, away_price_american FROM lines""",
    "d_quotes", extra={
        "pre": """SELECT *, max(snapshot_ts) OVER (PARTITION BY commence_time, home_team, away_team) AS chosen FROM d_quotes WHERE book_key <> 'other' AND snapshot_ts <= commence_time - INTERVAL 30 MINUTE""",
        "lines": """SELECT commence_time, home_team, away_team, chosen AS snapshot_ts, max(home_price_american) AS home_price_american, max(away_price_american) AS away_price_american
          FROM pre WHERE snapshot_ts = chosen AND abs(home_price_american) <= 500 AND abs(away_price_american) <= 500 GROUP BY 1, 2, 3, 4"""}))
def stream_latest_line(spark, d):
    quotes = _steps(spark, B.quotes(spark, d), "snapshot_ts", "quotes")
    out = jobs.newest_line(_drain(spark, jobs.stream_latest_line(quotes), "lines"))
    return out.select(epoch("commence_time").alias("start_s"), "home_team", "away_team", epoch("snapshot_ts").alias("snapshot_s"), "home_price_american", "away_price_american")


# A customer's year is a game that starts on the first of December, so orders of December come too late and states expire.
_SIGNALS = """SELECT o_custkey * 10000 + year(o_orderdate) AS game_id, CASE WHEN o_orderkey % 3 = 0 THEN 'home' WHEN o_orderkey % 3 = 1 THEN 'away' ELSE '' END AS recommended,
  o_orderdate AS rec_ts, o_totalprice AS odds FROM orders WHERE month(o_orderdate) < 12"""


@query("stream_first_signal", f"""
    SELECT game_id, recommended, odds FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY rec_ts, recommended, odds) AS rn FROM ({_SIGNALS}) WHERE recommended <> '') WHERE rn = 1""")
def stream_first_signal(spark, d):
    year = F.year("o_orderdate")
    signals = B.table(spark, d, "orders").select(
        (F.col("o_custkey") * 10000 + year).alias("game_id"), F.make_timestamp(year, F.lit(12), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("commence_time"),
        F.when(F.col("o_orderkey") % 3 == 0, "home").when(F.col("o_orderkey") % 3 == 1, "away").otherwise("").alias("recommended"),
        F.col("o_orderdate").cast("timestamp").alias("rec_ts"), F.col("o_totalprice").alias("odds"))
    stream = jobs.stream_first_signal(_steps(spark, signals, "rec_ts", "signals"))
    return _drain(spark, stream, "first-signals").select("game_id", "recommended", "odds")


@query("stream_settle", B.with_ctes(
    """SELECT game_id, CASE WHEN home_score = away_score THEN 'push' WHEN home_score > away_score THEN 'won' ELSE 'lost' END AS outcome,
      CASE WHEN home_score = away_score THEN 0 WHEN home_score > away_score THEN 0.8 ELSE -1 END::DOUBLE AS profit_units FROM d_games WHERE status <> 'Postponed'""", "d_games"))
def stream_settle(spark, d):
    g = B.games(spark, d)
    tickets = g.select("game_id", "commence_time", F.lit("home").alias("recommended_side"), F.lit(1.8).alias("decimal_at_rec"), F.lit(1.0).alias("risk_units"))
    results = g.where("status <> 'Postponed'").select(
        "game_id", (F.col("commence_time") + F.expr("INTERVAL 3 HOURS")).alias("final_ts"), "home_score", "away_score")
    joined = jobs.stream_settle(_restage(spark, tickets, "tickets"), _restage(spark, results, "results"))
    return _drain(spark, joined, "settled").select("game_id", "outcome", rnd("profit_units").alias("profit_units"))


@query("stream_ledger_upsert", """
    SELECT o_orderkey AS game_id, o_orderdate::DATE AS game_date, 'home' AS recommended, CAST(epoch(o_orderdate) AS BIGINT) AS snapshot_s, o_custkey AS home_id, round(o_totalprice, 2) AS home_price_american, 1.0::DOUBLE AS risk_units
    FROM orders WHERE o_orderstatus <> 'P'""")
def stream_ledger_upsert(spark, d):
    o = B.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("game_id"), F.to_date("o_orderdate").alias("game_date"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 20 HOURS")).alias("commence_time"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise("home").alias("recommended"),
        F.col("o_custkey").alias("home_id"), F.col("o_custkey").alias("away_id"), F.lit("H").alias("home_name"), F.lit("A").alias("away_name"),
        F.lit(0.5).alias("p_home"), F.col("o_orderdate").cast("timestamp").alias("snapshot_ts"), F.col("o_totalprice").alias("home_price_american"),
        *[F.lit(v).alias(n) for n, v in (("away_price_american", -130.0), ("home_decimal", 2.1), ("away_decimal", 1.77),
          ("home_fair_p", 0.47), ("away_fair_p", 0.53), ("edge_home", 0.03), ("edge_away", -0.03), ("recommended_ev", 0.05), ("recommended_kelly", 0.005),
          ("recommended_kelly_pre_daily", 0.005), ("risk_ref_kelly", 0.005), ("risk_units", 1.0))])
    from tidemark.sources.ledgerstore import read_ledger

    root, o = scratch_path(spark, "ledger-versions"), stage(o, "slates")
    middle = F.lit(o.agg(F.expr("percentile_approx(snapshot_ts, 0.5)")).first()[0])
    # Two jobs with checkpoints of their own, as after a restart; the second goes on from what the first has stored.
    for half in (o.where(F.col("snapshot_ts") <= middle), o.where(F.col("snapshot_ts") > middle)):
        slates = _steps(spark, half, "snapshot_ts", "slates")
        jobs.stream_ledger_upsert(slates, root, scratch_path(spark, "ledger-checkpoint"), lambda: "1990-01-01 00:00:00").awaitTermination()
    return read_ledger(spark, root).select("game_id", "game_date", F.col("recommended_side").alias("recommended"), epoch("rec_snapshot_ts").alias("snapshot_s"), "home_id",
                                           F.round("odds_at_rec", 2).alias("home_price_american"), "risk_units")
