import datetime as dt
import glob
import json
import os
import random
import tempfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.operators import ledger, odds
from tidemark.schemas import EVENTS, LEDGER, align, parse
from tidemark.sources import documents as D, ledgerstore as L, tables as T
from tidemark.streaming import jobs


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="spark-")


def put(root, name, doc):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(doc if isinstance(doc, str) else json.dumps(doc, indent=1))


def test_outcomes_skip_malformed(spark, root):
    game = {"game_id": 1, "game_date": "2024-05-01", "game_type": "R", "status": "Final", "home_score": 3, "away_score": "2"}
    put(root, "2024/2024-05-01.json", {"data": [game, {**game, "game_id": 2, "status": "Postponed"}]})
    put(root, "2024/2024-05-02.json", "{not json")
    got = {r.game_id: r for r in D.read_outcomes(spark, root).collect()}
    assert set(got) == {1, 2} and (got[1].home_score, got[1].away_score) == ("3", "2")


def side(order, pitchers, team=1):
    players = {f"ID{p}": {"person": {"fullName": f"P{p}"}, "position": {"abbreviation": "LF"}, "allPositions": [{"abbreviation": "CF"}, {"abbreviation": "LF"}]} for p in order}
    if order:
        players[f"ID{order[0]}"].pop("allPositions")
    return {"team": {"id": team}, "battingOrder": order, "pitchers": pitchers, "bullpen": [99], "players": players}


def test_boxscores(spark, root):
    put(root, "2024/1001.json", {"gameId": "x", "home": side([11, 12], [50, 51]), "away": side([21], [60], 2)})
    put(root, "2024/1002.json", {"gameId": "y", "home": side([], [50]), "away": side([21], [60])})
    put(root, "2024/notes.json", {"gameId": "z", "home": side([11], [50]), "away": side([21], [60])})
    got = D.read_boxscores(spark, root).collect()
    assert [r.game_id for r in got] == [1001]
    r = got[0]
    assert r.home_lineup_positions == ["LF", "CF"] and (r.home_starter_id, r.away_team_id) == (50, 2)
    docs = spark.read.schema(parse("gameId string, home string")).json(root)  # names come from the same documents
    assert docs is not None
    from tidemark.schemas import BOXSCORE_DOC
    names = {n.player_id: n.name for n in D.player_names(spark.read.schema(parse(BOXSCORE_DOC)).option("multiLine", True).option("recursiveFileLookup", True).json(root)).collect()}
    assert names == {11: "P11", 12: "P12", 21: "P21"}
    known = spark.createDataFrame([(11, "Old"), (5, "Kept")], "player_id long, name string")
    assert {r.player_id: r.name for r in D.upsert_player_names(known, spark.createDataFrame([(11, "New")], "player_id long, name string")).collect()} == {11: "New", 5: "Kept"}


def odds_doc(at, price=110.0):
    def market(key, outcomes):
        return {"key": key, "last_update": at, "outcomes": outcomes}

    both = [{"name": "H", "price": price}, {"name": "A", "price": -130}]
    return {"fetched_at_utc": at, "data": [{"id": "g1", "commence_time": "2024-05-02T01:00:00Z", "home_team": "H", "away_team": "A", "bookmakers": [
        {"key": "fanduel", "title": "FanDuel", "markets": [market("spreads", both), market("h2h", both)]},
        {"key": "betmgm", "title": "BetMGM", "markets": [market("h2h", both[:1])]},
        {"key": "other", "title": "Other", "markets": [market("totals", both)]}]}]}


def test_odds_snapshots_prune_by_folder(spark, root):
    for day, at in (("2024-04-30", "2024-04-30T12:00:00+00:00"), ("2024-05-01", "2024-05-01T12:00:00+00:00"), ("2024-05-03", "2024-05-03T12:00:00+00:00")):
        put(root, f"{day}/{at[:19].replace(':', '-')}Z.json", odds_doc(at))
    put(root, "2024-05-01/bad.json", "[oops")
    every = D.read_odds_snapshots(spark, root)
    assert every.count() == 3 and {r.book_key for r in every.collect()} == {"fanduel"}
    one = D.read_odds_snapshots(spark, root, "2024-05-01", "2024-05-02").collect()
    assert [(r.snapshot_ts, r.home_price_american) for r in one] == [(dt.datetime(2024, 5, 1, 12), 110.0)]
    late = D.read_odds_snapshots(spark, root, low="2024-05-02")
    assert late.count() == 1 and [f.split("/")[-2] for f in late.inputFiles()] == ["2024-05-03"]
    assert D.read_odds_snapshots(spark, root, low="2024-06-01").count() == 0


def test_odds_archives_hold_a_snapshot_on_each_line(spark, root):
    for day in ("2024-05-01", "2024-05-02"):
        os.makedirs(f"{root}/day={day}")
        with open(f"{root}/day={day}/part-0.json", "w") as f:
            f.write("\n".join(json.dumps(odds_doc(f"{day}T{h}:00:00+00:00", h)) for h in (11, 12)) + "\n{broken\n")
    got = D.read_odds_snapshots(spark, root, "2024-05-02", lines=True)
    assert sorted((r.snapshot_ts.day, r.home_price_american) for r in got.collect()) == [(2, 11.0), (2, 12.0)] and len(got.inputFiles()) == 1


def test_stream_odds_equals_batch(spark, root):
    put(root, "2024-05-01/a.json", odds_doc("2024-05-01T12:00:00+00:00"))
    put(root, "2024-05-01/b.json", odds_doc("2024-05-01T20:00:00+00:00", 125.0))
    sink, check = f"{root}-out", f"{root}-check"
    stream = jobs.stream_odds(spark, root)
    jobs.run_available(stream, sink, check)
    batch = D.read_odds_snapshots(spark, root)
    got = spark.read.schema(stream.schema).parquet(sink)
    cols = ["snapshot_ts", "book_key", "home_price_american"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))


def test_schedule(spark, root):
    put(root, "2024/2024-05-01.json", {"data": [{"game_id": 1, "game_date": "2024-05-01", "game_datetime": "2024-05-01T23:00:00Z"}, {"game_id": 2, "game_date": "2024-05-01", "game_datetime": "soon"}]})
    got = {r.game_id: r.game_datetime for r in D.read_schedule(spark, root, "2024-05-01").collect()}
    assert got == {1: dt.datetime(2024, 5, 1, 23), 2: None}
    assert D.read_schedule(spark, root, "2024-05-09").count() == 0


def test_events_fail_on_a_missing_season(spark, root):
    df = align(spark.createDataFrame([(1, dt.date(2024, 5, 1), 2024), (2, dt.date(2023, 5, 1), 2023)], "game_pk long, game_date date, game_year int"), EVENTS)
    T.write_partitions(df, root, ["game_year"])
    assert T.read_events(spark, root, [2024]).count() == 1
    assert T.read_events(spark, root, [2023, 2024]).count() == 2
    with pytest.raises(AnalysisException):
        T.read_events(spark, root, [2023, 2022]).count()


def test_partition_overwrite_is_idempotent_and_local(spark, root):
    for day, n in (("2024-05-01", 3), ("2024-05-02", 2), ("2024-05-01", 1)):
        T.write_day_partition(spark.range(n).withColumnRenamed("id", "game_id"), root, day, "ball")
    T.write_day_partition(spark.range(0).withColumnRenamed("id", "game_id"), root, "2024-05-09", "ball")
    got = {str(r.day): r["count"] for r in spark.read.parquet(root).groupBy("day").count().collect()}
    assert got == {"2024-05-01": 1, "2024-05-02": 2}


def test_append_dedupe(spark):
    cols = "game_pk long, batter long, pitcher long, balls int, strikes int, description string, game_date string, tag string"
    old = spark.createDataFrame([(1, 1, 1, 0, 0, "ball", "2024-05-01", "old")], cols)
    new = spark.createDataFrame([(1, 1, 1, 0, 0, "ball", "2024-05-02", "new"), (2, 1, 1, 0, 0, "ball", "2024-05-01", "stale"), (3, 1, 1, 0, 0, "ball", "2024-05-03", "new")], cols)
    assert sorted(r.tag for r in T.append_dedupe(old, new).collect()) == ["new", "new"]
    assert sorted(r.tag for r in T.append_dedupe(old, new, until="2024-05-01").collect()) == ["old"]


def test_append_stored_copies_the_months_it_touches(spark, root):
    where, cols = os.path.join(root, "log"), "k long, j string, game_date date, tag string"

    def day(*at):
        return dt.date(*at)

    def add(*given, **options):
        return T.append_stored(spark.createDataFrame(list(given), cols), where, ["k", "j"], **options)

    assert T.stored_months(spark, where) == [] and add((1, "a", None, "undated")) == []
    assert add((1, "a", day(2024, 1, 5), "x"), (1, "a", day(2024, 1, 6), "y"), (2, None, day(2024, 2, 1), "x"), (9, "z", day(2024, 3, 1), "x")) == ["2024-01", "2024-02", "2024-03"]
    untouched = os.path.join(where, "month=2024-01")
    before = sorted(os.listdir(untouched))
    later = [(2, None, day(2024, 3, 9), "new"), (3, "c", day(2024, 3, 9), "new"), (9, "q", day(2024, 2, 28), "stale"), (4, "d", day(2024, 5, 1), "far")]
    assert add(*later, until="2024-04-30") == ["2024-02", "2024-03"]
    got = lambda: sorted((r.k, str(r.j), r.tag) for r in spark.read.parquet(where).collect())
    assert got() == [(1, "a", "y"), (2, "None", "new"), (3, "c", "new"), (9, "z", "x")]
    assert T.stored_months(spark, where) == ["2024-01", "2024-03"] and sorted(os.listdir(untouched)) == before
    assert add(*later, until="2024-04-30") == [] and add(*later) == ["2024-05"]
    assert (4, "d", "far") in got() and len(got()) == 5


def test_ledger_versions(spark, root):
    where = os.path.join(root, "ledger")
    assert L.read_ledger(spark, where).count() == 0
    L.write_ledger(spark.createDataFrame([(1, None)], "game_id long, risk_units double"), where)
    L.write_ledger(spark.createDataFrame([(1, 1.5), (2, None)], "game_id long, risk_units double"), where)
    got = L.read_ledger(spark, where)
    assert got.columns == parse(LEDGER).names
    assert {r.game_id: r.risk_units for r in got.collect()} == {1: 1.5, 2: 1.0}
    assert {r.game_id: r.risk_units for r in L.read_ledger(spark, where, 0).collect()} == {1: 1.0}


def _slate(spark, rows):
    df = spark.createDataFrame(rows, "game_id long, game_date date, commence_time timestamp, recommended string, snapshot_ts timestamp, odds double")
    return df.withColumns({n: F.lit(v) for n, v in (
        ("home_id", 1), ("away_id", 2), ("home_name", "H"), ("away_name", "A"), ("p_home", 0.5), ("away_price_american", -130.0), ("home_decimal", 2.1), ("away_decimal", 1.77),
        ("home_fair_p", 0.47), ("away_fair_p", 0.53), ("edge_home", 0.03), ("edge_away", -0.03), ("recommended_ev", 0.05), ("recommended_kelly", 0.005),
        ("recommended_kelly_pre_daily", 0.005), ("risk_ref_kelly", 0.005), ("risk_units", 1.0))}).withColumnRenamed("odds", "home_price_american")


def test_merges_touch_the_months_of_their_batch(spark, root):
    """Every merge equals the merge of the whole ledger, and folders of other months stay as they are."""
    where, day, now = f"{root}/ledger", dt.date(2024, 1, 1), "2023-01-01 00:00:00"
    whole = L.read_ledger(spark, where)
    rng = random.Random(3)
    before = {}
    for step in range(4):
        rows = []
        for _ in range(12):
            game = rng.randint(0, 30)
            when = day + dt.timedelta(days=45 * step + rng.randint(0, 20) + (5 if game % 7 == 0 else 0))  # some games move to another date
            rows.append((game, when, dt.datetime(2024, 12, 1), rng.choice(["home", "away", ""]), dt.datetime(2023, 1, 1, step), float(rng.randint(100, 200))))
        batch = _slate(spark, rows)
        assert L.merge_slate(batch, where, now, f"job#{step}") == step
        assert L.merge_slate(batch, where, now, f"job#{step}") is None  # a retry
        whole = spark.createDataFrame(ledger.merge_recommendations(whole, batch, now).drop("action").collect(), parse(LEDGER))
        got = L.read_ledger(spark, where)
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))  # every column
        months = L.read_manifest(spark, where)["months"]
        assert sum(m["rows"] for m in months.values()) == whole.count()
        before = months
    far = _slate(spark, [(900, dt.date(2030, 1, 1), dt.datetime(2030, 1, 2), "home", dt.datetime(2029, 1, 1), 100.0)])
    L.merge_slate(far, where, now, "job#far")
    after = L.read_manifest(spark, where)["months"]
    assert {m: e for m, e in after.items() if m != "2030-01"} == before and after["2030-01"]["rows"] == 1
    assert L.expire(spark, where, keep=1) > 0 and L.versions(spark, where) == [4]
    assert L.read_ledger(spark, where).count() == whole.count() + 1
    assert L.merge_slate(_slate(spark, [(901, None, None, "", None, None)]), where, now, "job#none") == 5  # nothing recommended
    assert L.merge_slate(_slate(spark, [(902, None, None, "home", None, None)]), where, now, "job#undated") == 6
    assert L.read_manifest(spark, where)["months"]["none"]["rows"] == 1


def test_saved_snapshots(spark, root):
    T.save_snapshot(spark.range(1), root, "2024-05-01T00-00-00Z")
    T.save_snapshot(spark.range(3), root, "2024-05-02T00-00-00Z")
    assert T.read_latest_snapshot(spark, root).count() == 3


def test_reference_slices(spark):
    row = spark.createDataFrame([("109", "x")], "main_team_id string, n_pa string")
    both = T.stack_bat_sides(row, row, 2024).collect()
    assert {(r.bat_side, r.main_team_id, r.n_pa) for r in both} == {("R", 109, None), ("L", 109, None)}
    oaa = spark.createDataFrame([("7", 5.0, "4%"), ("bad", 0.0, "0%")], "player_id string, outs_above_average double, diff_success_rate_formatted string")
    got = T.stack_fielding({6: oaa, 8: oaa}).collect()
    assert {(r.position_abbrev, r.player_id, r.attempts) for r in got} == {("SS", 7, 125), ("SS", None, None), ("CF", 7, 125), ("CF", None, None)}


def test_first_signal_survives_later_batches(spark, root):
    schema = "game_id long, commence_time timestamp, recommended string, rec_ts timestamp, odds double"
    start = dt.datetime(2024, 6, 1)

    def batch(*rows):
        data = [(g, start, r, dt.datetime(2024, 5, 1, h), o) for g, r, h, o in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(root)

    def drain():
        stream = jobs.stream_first_signal(spark.readStream.schema(schema).parquet(root))
        jobs.run_available(stream, f"{root}-out", f"{root}-check")

    batch((1, "away", 2, 105.0), (1, "home", 1, 110.0), (2, "", 1, 100.0))
    drain()
    batch((1, "away", 3, 150.0), (2, "home", 4, 120.0))
    drain()
    got = spark.read.schema(schema).parquet(f"{root}-out").collect()
    assert sorted((r.game_id, r.recommended, r.odds) for r in got) == [(1, "home", 110.0), (2, "home", 120.0)]


def test_team_keys_reject_unknown_names(spark):
    games = spark.createDataFrame([("H", 1, "A", 2)], "home_name string, home_id long, away_name string, away_id long")
    lines = spark.createDataFrame([("H", "A"), ("H", "?")], "home_team string, away_team string")
    good, bad = odds.attach_team_ids(lines, odds.team_keys(games))
    assert good.select("home_id", "away_id").collect() == [(1, 2)]
    assert [r.away_team for r in bad.collect()] == ["?"]


QUOTE = "snapshot_ts timestamp, commence_time timestamp, home_team string, away_team string, book_key string, home_price_american double, away_price_american double"


def test_latest_line_is_not_made_late_by_a_far_game(spark, root):
    """A quote for a game eleven days ahead, then later quotes of today's game and of a new one."""
    day = dt.datetime(2024, 5, 1, 20)

    def batch(*rows):
        data = [(dt.datetime(2024, 5, 1, h), start, a, b, "draftkings", p, -p) for h, start, a, b, p in rows]
        spark.createDataFrame(data, QUOTE).coalesce(1).write.mode("append").parquet(root)
        stream = jobs.stream_latest_line(spark.readStream.schema(QUOTE).parquet(root))
        jobs.run_available(stream, f"{root}-out", f"{root}-check")

    batch((9, day, "T", "U", 100.0), (9, day + dt.timedelta(days=11), "X", "Y", 130.0))
    batch((15, day, "T", "U", 140.0), (15, day + dt.timedelta(days=1), "V", "W", 120.0))
    batch((16, day, "T", "U", 900.0), (16, day + dt.timedelta(days=1), "V", "W", 125.0))
    got = jobs.newest_line(spark.read.parquet(f"{root}-out")).collect()
    assert {(r.home_team, r.home_price_american) for r in got} == {("X", 130.0), ("V", 125.0)}  # the last quote of T is not plausible


def test_first_signal_is_not_repeated_after_the_start(spark, root):
    schema = "game_id long, commence_time timestamp, recommended string, rec_ts timestamp, odds double"
    start = dt.datetime(2024, 5, 2)

    def batch(*rows):
        data = [(g, s, "home", dt.datetime(2024, 5, day), o) for g, s, day, o in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(root)
        jobs.run_available(jobs.stream_first_signal(spark.readStream.schema(schema).parquet(root)), f"{root}-out", f"{root}-check")

    batch((1, start, 1, 110.0))
    batch((2, start + dt.timedelta(days=60), 18, 120.0))  # moves the watermark past the start of the first
    batch((1, start, 20, 150.0))
    got = spark.read.schema(schema).parquet(f"{root}-out").collect()
    assert sorted((r.game_id, r.odds) for r in got) == [(1, 110.0), (2, 120.0)]


def test_ledger_goes_on_after_a_new_checkpoint(spark, root):
    slates = "game_id long, game_date date, commence_time timestamp, recommended string, home_id long, away_id long, home_name string, away_name string, p_home double, snapshot_ts timestamp"

    def batch(game, check):
        when = dt.datetime(2024, 5, game)
        row = [(game, when.date(), when, "home", 1, 2, "H", "A", 0.5, when)]
        df = spark.createDataFrame(row, slates).withColumns({n: F.lit(v) for n, v in (
            ("home_price_american", 110.0), ("away_price_american", -130.0), ("home_decimal", 2.1), ("away_decimal", 1.77), ("home_fair_p", 0.47), ("away_fair_p", 0.53),
            ("edge_home", 0.03), ("edge_away", -0.03), ("recommended_ev", 0.05), ("recommended_kelly", 0.005), ("recommended_kelly_pre_daily", 0.005),
            ("risk_ref_kelly", 0.005), ("risk_units", 1.0))})
        df.coalesce(1).write.mode("append").parquet(f"{root}/in-{check}")
        stream = spark.readStream.schema(df.schema).parquet(f"{root}/in-{check}")
        jobs.stream_ledger_upsert(stream, f"{root}/ledger", f"{root}/check-{check}", lambda: "2024-05-01 00:00:00").awaitTermination()

    batch(1, "a")
    batch(2, "a")
    batch(3, "b")  # as after a restart that lost its checkpoint
    assert {r.game_id for r in L.read_ledger(spark, f"{root}/ledger").collect()} == {1, 2, 3}


def test_no_odds_of_a_range_are_no_rows(spark, root):
    assert D.read_odds_snapshots(spark, f"{root}/nowhere", "2024-05-01", "2024-05-02").count() == 0


def test_a_ledger_that_cannot_be_read_is_an_error(spark, root):
    L.write_ledger(spark.createDataFrame([(1, None)], "game_id long, risk_units double"), f"{root}/ledger")
    for part in glob.glob(f"{root}/ledger/data/*/*/*.parquet"):
        open(part, "w").write("not parquet")
    with pytest.raises(Exception):
        L.read_ledger(spark, f"{root}/ledger").agg({"risk_units": "sum"}).collect()
