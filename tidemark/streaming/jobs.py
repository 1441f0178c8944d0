"""Structured Streaming forms of the polling jobs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark import constants as K
from tidemark.functions import pricing as P
from tidemark.operators import ledger, odds
from tidemark.schemas import ODDS_DOC, parse
from tidemark.sources.documents import quotes_long

LATE = "3 days"


def stream_odds(spark: SparkSession, root: str) -> DataFrame:
    """Quotes from snapshot files as they land under ``<root>/<date>/``."""
    docs = (
        spark.readStream.schema(parse(ODDS_DOC)).option("multiLine", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json").json(root)
    )
    return quotes_long(docs.withColumn("source", F.col("_metadata.file_path")))


_LINE = "commence_time timestamp, home_team string, away_team string, snapshot_ts timestamp, home_price_american double, away_price_american double"

#: Groups of a keyed state. A group holds the live games of its share, so a call of Python serves many games and not one.
BUCKETS = 512


def _bucket(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _micros(column: pd.Series) -> pd.Series:
    return column.astype("datetime64[us]").astype("int64")


def _keep(state: GroupState, rows: pd.DataFrame, start: str) -> None:
    """Store the rows of games that start after the watermark; the state expires with the last of them."""
    mark = state.getCurrentWatermarkMs()
    live = rows[rows[start] > mark * 1000]
    if live.empty:
        if state.exists:
            state.remove()
        return
    state.update((json.dumps([live[c].astype(object).where(live[c].notna(), None).tolist() for c in live]),))
    state.setTimeoutTimestamp(max(int(live[start].max()) // 1000, mark + 1))


def stream_latest_line(quotes: DataFrame, minutes: int = K.CLOSE_MINUTES, delay: str = LATE,
                       books: Sequence[str] | None = K.DEFAULT_BOOKS) -> DataFrame:
    """Best plausible prices of the latest snapshot before each game's cutoff: a row whenever a game's line changes.

    The watermark follows ``snapshot_ts``, so a quote for a far game makes no other quote late. State is one line per game, kept in
    ``BUCKETS`` groups, and expires once the watermark has passed the game's start, after which no quote of it is before the cutoff.
    A NULL price beats nothing but its own snapshot still counts as the latest one: its row has NULL prices. ``newest_line`` gives the
    state of all games from the rows so far.
    """
    pre = odds.before_cutoff(odds.quote_filters(quotes, books, None), minutes).withWatermark("snapshot_ts", delay)
    ok = (F.abs("home_price_american") <= K.EXTREME_PRICE) & (F.abs("away_price_american") <= K.EXTREME_PRICE)
    prices = ["home_price_american", "away_price_american"]
    plausible = pre.select(*odds.GAME_KEYS, "snapshot_ts", *[F.when(ok, F.col(p)).cast("double").alias(p) for p in prices])
    keys = list(odds.GAME_KEYS)
    names = [*keys, "snapshot_ts", *prices]

    def lines(rows: pd.DataFrame) -> pd.DataFrame:
        """The highest prices of each game's latest snapshot."""
        newest = rows.groupby(keys, dropna=False, sort=False)["snapshot_ts"].transform("max")
        return rows[rows["snapshot_ts"] == newest].groupby([*keys, "snapshot_ts"], dropna=False, sort=False, as_index=False)[prices].max()

    def typed(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.astype({"commence_time": "int64", "snapshot_ts": "int64", **{p: "float64" for p in prices}})

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = typed(pd.DataFrame(dict(zip(names, json.loads(state.get[0]))), columns=names)) if state.exists else None
        parts = [] if before is None else [before]
        for batch in batches:  # each batch is reduced before the next is read
            if len(batch):
                parts.append(lines(typed(batch[names].assign(commence_time=_micros(batch["commence_time"]), snapshot_ts=_micros(batch["snapshot_ts"])))))
        if not parts:
            return
        now = lines(pd.concat(parts, ignore_index=True))
        changed = now if before is None else now.merge(before, how="left", on=names, indicator="_seen").query("_seen == 'left_only'")[names]
        _keep(state, now, "commence_time")
        if len(changed):
            yield changed.assign(commence_time=pd.to_datetime(changed["commence_time"], unit="us"), snapshot_ts=pd.to_datetime(changed["snapshot_ts"], unit="us"))

    return plausible.withColumn("_bucket", _bucket(keys)).groupBy("_bucket").applyInPandasWithState(update, _LINE, "games string", "append", GroupStateTimeout.EventTimeTimeout)


def newest_line(changes: DataFrame) -> DataFrame:
    """The line of each game from the changes of ``stream_latest_line``; games whose latest snapshot has no plausible price are left out.

    Of changes within one snapshot the later one has the higher prices.
    """
    latest = changes.groupBy(*odds.GAME_KEYS).agg(F.max(F.struct("snapshot_ts", "home_price_american")).alias("_h"), F.max(F.struct("snapshot_ts", "away_price_american")).alias("_a"))
    return latest.where(F.col("_h.home_price_american").isNotNull()).select(
        *odds.GAME_KEYS, F.col("_h.snapshot_ts").alias("snapshot_ts"), F.col("_h.home_price_american").alias("home_price_american"),
        F.col("_a.away_price_american").alias("away_price_american"))


_SIGNAL = "game_id long, commence_time timestamp, recommended string, rec_ts timestamp, odds double"


def stream_first_signal(signals: DataFrame, delay: str = LATE) -> DataFrame:
    """Freeze the first recommendation of each game before it has started.

    ``signals``: game_id, commence_time, recommended, rec_ts, odds. Recommendations from the start on do not count. The
    state of a game is its latest known start, kept in ``BUCKETS`` groups; it expires when the watermark has passed that, as every
    later row is then either late or from after the start.
    """
    order = ["rec_ts", "recommended", "odds"]

    def first(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        nameless = pd.isna(key[0])
        known = pd.DataFrame(dict(zip(("game_id", "start"), json.loads(state.get[0])))).astype("int64") if state.exists else None
        tops, starts = [], [] if known is None else [known]
        for batch in batches:  # one earliest row of each game and Arrow batch: the group is never gathered whole
            if len(batch):
                batch = (batch.assign(game_id=0) if nameless else batch).sort_values(order)
                tops.append(batch.drop_duplicates("game_id")[["game_id", "commence_time", *order]])
                starts.append(batch.assign(start=_micros(batch["commence_time"])).groupby("game_id", as_index=False)["start"].max())
        if not starts:
            return
        _keep(state, pd.concat(starts, ignore_index=True).groupby("game_id", as_index=False)["start"].max(), "start")
        if tops:
            earliest = pd.concat(tops, ignore_index=True).sort_values(order).drop_duplicates("game_id")
            if known is not None:
                earliest = earliest[~earliest["game_id"].isin(known["game_id"])]
            if len(earliest):
                yield earliest.assign(game_id=pd.Series([None] * len(earliest), dtype="Int64")) if nameless else earliest

    picks = signals.where(F.col("recommended").isin("home", "away") & (F.col("rec_ts") < F.col("commence_time"))).withWatermark("rec_ts", delay)
    # A game without an id has a group of its own, so ids stay whole numbers in the others.
    grouped = picks.withColumn("_bucket", F.when(F.col("game_id").isNotNull(), _bucket(["game_id"]))).groupBy("_bucket")
    return grouped.applyInPandasWithState(
        first, _SIGNAL, "games string", "append", GroupStateTimeout.EventTimeTimeout)


def stream_settle(tickets: DataFrame, results: DataFrame, delay: str = LATE, within: str = "7 days") -> DataFrame:
    """Tickets joined with final scores that arrive within ``within`` of the start.

    ``tickets``: game_id, commence_time, recommended_side, decimal_at_rec, risk_units;
    ``results``: game_id, final_ts, home_score, away_score.
    """
    t = tickets.withWatermark("commence_time", delay).alias("t")
    r = results.withWatermark("final_ts", delay).alias("r")
    joined = t.join(r, F.expr(
        f"t.game_id = r.game_id AND r.final_ts >= t.commence_time AND r.final_ts <= t.commence_time + INTERVAL {within}"))
    outcome = P.outcome_of(F.col("recommended_side"), F.col("home_score"), F.col("away_score"))
    return joined.select(
        F.col("t.game_id").alias("game_id"), "commence_time", "final_ts", outcome.alias("outcome"),
        P.settle_profit(outcome, F.col("decimal_at_rec"), F.col("risk_units")).alias("profit_units"))


def stream_dedupe_append(events: DataFrame, keys: Sequence[str], ts: str, delay: str = LATE) -> DataFrame:
    """First row per key among rows no further apart than ``delay``."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_daily_counts(events: DataFrame, keys: Sequence[str], ts: str, aggregates: dict, delay: str = LATE,
                        window: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counters per key and calendar window; with ``slide`` the windows overlap."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return events.withWatermark(ts, delay).groupBy(*keys, w.alias("w")).agg(
        *[c.alias(n) for n, c in aggregates.items()]).select(
        *keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *aggregates)


def stream_ledger_upsert(slates: DataFrame, root: str, checkpoint: str, now: Callable[[], str]):
    """Merge every micro-batch of recommendations into the next version of a stored ledger (``ledgerstore``).

    A version is one more than the newest one, whatever the batch number, so a job that starts anew goes on from the stored
    ledger. Each version names the job and batch that wrote it; a retried batch that is stored already is left alone.
    """
    from tidemark.sources.ledgerstore import merge_slate

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_slate(batch, root, now(), f"{checkpoint}#{batch_id}")

    return slates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Drain what has arrived into a Parquet folder and stop."""
    q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
