"""Steps that must not grow out of the driver, a double or an executor: the shape of their plans, and results at the edge."""

import datetime as dt
import glob
import math
import re
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bets, bullpen, reshape, ridge
from tidemark import session
from tidemark.plans import bindings, checks_games, checks_model, checks_pool, slate as SL
from tidemark.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stacked(spark):
    return reshape.stack_sides(checks_model.featured_games(spark, SF))


def _aggregated_before_the_join(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.index("Join") < plan.index("Aggregate")  # the tree is printed from its top


def test_residuals_join_no_rows_of_games(stacked):
    """The rows of runs_model, once exploded by feature, were broadcast as their size was underrated."""
    model = ridge.fit_ridge(stacked, checks_model.PAIR).drop("feature_set").withColumns({"through": F.lit(2100), "feature_set": F.lit("pair")})
    out = checks_model._fit_residuals(stacked, model)
    assert _aggregated_before_the_join(out)
    assert [abs(round(r.residual, 9)) for r in out.collect()] == [0.0, 0.0]


def test_window_residuals_join_no_rows_of_games(stacked):
    out = checks_model._fit_residuals(stacked, ridge.fit_windows(stacked, checks_model._SETS))
    assert _aggregated_before_the_join(out)
    assert out.where(F.abs("residual") > 1e-9).count() == 0


def test_models_share_their_terms(spark, stacked):
    """A formula for each of fourteen models made code beyond what is compiled; now a feature is read once, however many models there are."""
    few, many = (ridge.fit_windows(stacked, checks_model._SETS, windows=range(1995, 1995 + n)) for n in (1, 4))
    plans = [ridge.score_models(stacked, m)._jdf.queryExecution().optimizedPlan().toString() for m in (few, many)]
    assert plans[0].count("coalesce(off_HR_pct") == plans[1].count("coalesce(off_HR_pct") == 1


def test_sweep_states_growth_beyond_a_double(spark):
    """Three won bets of 1e200 times the bankroll: their product has no double."""
    rows = [(i, dt.datetime(2024, 5, i), 0.5, -0.5, 0.04, -0.04, 1e198, 0.0, 10000.0, -10000.0, 5, 3) for i in (1, 2, 3)]
    s = spark.createDataFrame(rows, """game_id long, commence_time timestamp, ev_home double, ev_away double, edge_home double, edge_away double, kelly_home double,
        kelly_away double, home_price_american double, away_price_american double, home_score long, away_score long""")
    row = bets.threshold_sweep(s, thresholds=(0.0,)).first()
    assert math.isinf(row.bankroll_growth_pct) and row.log_growth == pytest.approx(600 * math.log(10))


def test_report_orders_equal_values_by_game(spark):
    names = ("home_name", "away_name", "home_book", "away_book", "home_price_american", "away_price_american", "p_home", "home_fair_p", "away_fair_p",
             "edge_home", "edge_away", "recommended_kelly", "commence_time", "away_runs_pred", "home_runs_pred")
    rows = spark.createDataFrame([(1, 0.3, "home"), (2, 0.1 + 0.2, "home"), (3, 0.4, "home")], "game_id long, recommended_ev double, recommended string")
    chosen, _ = SL.slate_report(rows.withColumns({n: F.lit("x") if n.endswith(("name", "book")) else F.lit(0.5) for n in names}))
    assert [r.game_id for r in chosen.collect()] == [3, 1, 2]


def test_streams_call_python_for_groups_of_games(spark, tmp_path):
    """Three thousand games, one of them without an id: a call for each game took minutes for a million."""
    n, root = 3000, str(tmp_path)
    signals = spark.range(n).select(
        F.when(F.col("id") > 0, F.col("id")).alias("game_id"), F.lit(dt.datetime(2024, 5, 9)).alias("commence_time"),
        F.explode(F.array(F.lit("home"), F.lit("away"))).alias("recommended"), F.lit(dt.datetime(2024, 5, 1)).alias("rec_ts"), F.col("id").cast("double").alias("odds"))
    for _ in range(2):
        signals.write.mode("append").parquet(f"{root}/s")
        jobs.run_available(jobs.stream_first_signal(spark.readStream.schema(signals.schema).parquet(f"{root}/s")), f"{root}/out", f"{root}/check")
    got = spark.read.parquet(f"{root}/out")
    assert got.count() == n and got.where("recommended = 'away'").agg(F.count_distinct("odds")).first()[0] == n and got.where("game_id IS NULL").count() == 1
    quotes = spark.range(n).select(
        F.lit(dt.datetime(2024, 5, 1)).alias("snapshot_ts"), F.lit(dt.datetime(2024, 5, 9)).alias("commence_time"), F.col("id").cast("string").alias("home_team"),
        F.lit("A").alias("away_team"), F.lit("draftkings").alias("book_key"), F.explode(F.array(F.lit(110.0), F.lit(120.0))).alias("home_price_american"),
        F.lit(None).cast("double").alias("away_price_american"))
    for _ in range(2):
        quotes.write.mode("append").parquet(f"{root}/q")
        jobs.run_available(jobs.stream_latest_line(spark.readStream.schema(quotes.schema).parquet(f"{root}/q")), f"{root}/lines", f"{root}/check-lines")
    changes = spark.read.parquet(f"{root}/lines")
    assert changes.count() == n  # the second reading of the same quotes changes nothing
    state = glob.glob(f"{root}/check/state/0/**/*.delta", recursive=True)
    stream = spark.read.format("statestore").load(f"{root}/check")
    assert state and stream.count() <= jobs.BUCKETS + 1


@pytest.mark.parametrize("query", ["odds_flatten", "boxscore_flatten", "schedule_flatten", "outcomes_flatten"])
def test_documents_are_parsed_once(spark, query):
    """Filters on parsed fields, moved below the parser, parsed the texts three to five times."""
    plan = getattr(checks_games, query)(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_snapshot_texts_are_packed(spark, tmp_path, monkeypatch):
    """The documents of quotes were moved as text and written plain, 460 bytes a quote."""
    monkeypatch.setattr(checks_games, "scratch_path", lambda spark, label: f"{tmp_path}/{label}")
    rows = checks_games.odds_snapshot_ranges(spark, SF).agg(F.sum("n")).first()[0]
    files = glob.glob(f"{tmp_path}/odds/**/part-*", recursive=True)
    assert rows and files and all(f.endswith(".txt.lz4") for f in files)


def test_event_log_is_written_once(spark, monkeypatch):
    """The pitches were staged whole and sorted by season in tasks of a whole file."""
    def no(df, label):
        raise AssertionError(label)

    monkeypatch.setattr(checks_games, "stage", no)
    assert checks_games.event_seasons(spark, SF).count() == 21


def test_domain_queries_join_many_partitions(spark):
    """Tasks held a share of the shuffle that grew with the table, as there were no more partitions than the session has."""
    import __spark_entry__

    names = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.requireAllClusterKeysForCoPartition")
    try:
        __spark_entry__.queries()["home_records"](spark, SF)
        assert [spark.conf.get(n) for n in names] == ["1000", "false"]
    finally:
        for n in names:
            spark.conf.unset(n)


def test_stage_leaves_no_shuffle_behind(spark):
    """Shuffles of staged tables stayed on disk until the driver collected garbage."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {n for n in (f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles())) if n.startswith("shuffle_")}

    before = shuffles()
    staged = session.stage(spark.range(10000).groupBy((F.col("id") % 1000).alias("k")).count(), "grouped")
    end = time.time() + 20
    while shuffles() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffles() - before and staged.count() == 1000


def test_hitter_rows_are_dealt_once(spark):
    """With their statistics, hitter rows were shuffled by game and side, and the two sides of a game once more, all columns of both."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # small tables would be broadcast
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        plan = checks_games.training(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    assert not re.search(r"Exchange hashpartitioning\(game_id#\d+L?, side#", plan)


def _dealt_by_more_than_a_game(spark, make):
    """Exchanges by a game or order and more, when small tables are not broadcast."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        plan = make()._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return re.findall(r"Exchange hashpartitioning\((?:l_orderkey|game_id|game_pk)#\d+L?, [a-z_].*", plan)


def test_items_of_lineups_are_dealt_once(spark):
    """Slots were shuffled by game, side and slot, and by game again; starters by game and side, by game, and with the games once more."""
    assert not _dealt_by_more_than_a_game(spark, lambda: bindings.lineups_long(spark, SF))
    assert not _dealt_by_more_than_a_game(spark, lambda: checks_games._history(spark, SF)[0])


def test_projection_ends_without_reading_items(spark):
    """The games with their starters were made from the items again for every reader of the schedule, and cards put into words for every game."""
    plan = checks_games.project_lineups(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "concat_ws" not in plan


def test_box_scores_deal_items_once(spark):
    """Cards and pitchers were each shuffled by game, side and slot or pitcher, then by game and side, and by game again."""
    assert not _dealt_by_more_than_a_game(spark, lambda: bindings.lineups_wide(spark, SF))


def test_pool_pitches_are_narrow_and_dealt_by_game(spark, monkeypatch):
    """All eighteen columns of a pitch were written, and appearances were shuffled by game, pitcher and date and by game and pitcher."""
    written = {}
    monkeypatch.setattr(checks_pool, "stage", lambda df, label: written.setdefault(label, session.stage(df, label)))
    checks_pool.pool_composites(spark, SF)
    assert len(written["pitches"].columns) == 11
    assert not _dealt_by_more_than_a_game(spark, lambda: bullpen.appearances(written["pitches"], bindings.staffs_wide(spark, SF), stored=True))


def test_no_generated_method_is_left_to_the_interpreter(spark):
    """Match-ups of a hitter row took 58 microseconds in one interpreted method and 12 in smaller ones."""
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    try:
        session.configure_domain(spark)
        assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", before)
