"""A fast cross-section of the registered queries against their SQL; ``check.py`` runs them all."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from check import TABLES, _norm

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUICK = ("asof_running_rates", "joint_index", "clean_outcomes", "team_defense", "trailing_pool_topn", "best_lines",
         "annotate_bets_one_slate", "bankroll_history", "ledger_merge", "exact_quantiles", "ridge_coefficients", "lineup_pool_facts",
         "stream_daily_counts", "stream_first_signal", "predict_slate", "slate_report", "coefficient_table", "stored_model", "platt_parameters", "isotonic",
         "window_models", "expanding_ablation", "project_lineups", "feature_table_roundtrip", "event_seasons")
#: Floors on samples leave nothing of the smallest tables.
LARGE = ("season_leaders",)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def _tables(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def connections():
    return {folder: _tables(folder) for folder in (SF, LARGER)}


@pytest.mark.parametrize("name,folder", [*((n, SF) for n in QUICK), *((n, LARGER) for n in LARGE)])
def test_query_matches_its_oracle(spark, connections, name, folder):
    df = entry.queries()[name](spark, folder)
    got = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns)
    cur = connections[folder].execute(entry.oracle_sql()[name])
    want = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description])
    assert len(got) > 0
    pd.testing.assert_frame_equal(_norm(got), _norm(want))


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns[:3] == ["game_id", "side", "starter_id"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
