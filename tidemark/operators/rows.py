"""Row selection: filters, de-duplication, top-n, set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark import constants as K


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key. The literal bound lets Spark trim each map task
    to ``n`` rows per key before the shuffle, so a hot key stays cheap."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key by ``order``; give a total order for a deterministic pick."""
    return top_n(df, keys, [F.col(c).desc_nulls_last() for c in order], 1)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return top_n(df, keys, [F.col(c).asc_nulls_last() for c in order], 1)


def leaderboard(df: DataFrame, value: str, n: int, *, floor: tuple[str, float] | None = None,
                ascending: bool = True, tie: Sequence[str] = (), by: Sequence[str] = (), place: str | None = None) -> DataFrame:
    """Best ``n`` rows by ``value`` among those above a sample floor, of each group of ``by`` if given, with their ``place``."""
    if floor:
        df = df.where(F.col(floor[0]) >= floor[1])
    lead = F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last()
    if by:
        return top_n(df, by, [lead, *map(F.col, tie)], n, place)
    return df.orderBy(lead, *tie).limit(n)


def latest_per_group(df: DataFrame, keys: Sequence[str], date: str, tie: Sequence[str] = ()) -> DataFrame:
    """End-of-period row per group."""
    return keep_last(df, keys, [date, *tie])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def tagged_union(slices: dict, tag: str) -> DataFrame:
    """Stack slices of one table, recording which slice each row came from."""
    return union_all([df.withColumn(tag, F.lit(value)) for value, df in slices.items()])


def without(history: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """History rows whose key is not in the batch."""
    return history.join(batch.select(*keys).distinct(), list(keys), "left_anti")


def replace_batch(history: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """History minus the batch's keys, plus the batch."""
    return without(history, batch, keys).unionByName(batch, allowMissingColumns=True)


def pa_end_filter(pitches: DataFrame) -> DataFrame:
    return pitches.where(F.col("events").isin(*K.PA_ENDING_EVENTS))


def sample_floor(df: DataFrame, columns: Sequence[str], sample: str, minimum: float) -> DataFrame:
    """NULL-out ``columns`` where the sample is missing or below ``minimum``."""
    if minimum <= 0:
        return df
    enough = F.col(sample) >= minimum
    return df.withColumns({c: F.when(enough, F.col(c)) for c in columns if c != sample and c in df.columns})


def prefix_project(df: DataFrame, columns: Sequence[str], prefix: str = "", suffix: str = "") -> DataFrame:
    """Rename ``columns`` to ``<prefix><name><suffix>``, leaving the rest."""
    chosen = set(columns)
    return df.select(*[F.col(c).alias(f"{prefix}{c}{suffix}") if c in chosen else F.col(c) for c in df.columns])


def clean_outcomes(raw: DataFrame, *, finals_only: bool = True, countable_only: bool = True,
                   tie: Sequence[str] = ()) -> DataFrame:
    """Countable games with numeric scores and labels, one row per game (the later date)."""
    df = raw
    if finals_only:
        df = df.where(F.col("status").isin(*K.FINAL_STATUSES))
    if countable_only:
        df = df.where(F.col("game_type").isin(*K.REGULAR_TYPES, *K.POSTSEASON_TYPES))
    df = df.withColumns({
        "home_score": F.expr("try_cast(home_score AS BIGINT)"),
        "away_score": F.expr("try_cast(away_score AS BIGINT)"),
        "game_date": F.to_date("game_date"),
    })
    df = keep_last(df, ["game_id"], ["game_date", *tie])
    home, away = F.col("home_score"), F.col("away_score")
    return df.withColumns({
        "home_win": home > away,
        "run_diff": home - away,
        "total_runs": home + away,
        "is_postseason": F.col("game_type").isin(*K.POSTSEASON_TYPES),
    })


def attach_hand(games: DataFrame, hands: DataFrame, *, id_col: str, out: str) -> DataFrame:
    """Fill a throwing-hand column from a (player_id, hand) lookup; a given value wins."""
    lookup = hands.select(F.col("player_id").alias(id_col), F.col("hand").alias("_hand"))
    given = F.col(out) if out in games.columns else F.lit(None).cast("string")
    return games.join(lookup, id_col, "left").withColumn(out, F.coalesce(given, F.col("_hand"))).drop("_hand")


def attach_names(df: DataFrame, names: DataFrame, id_col: str, name_col: str = "player_name") -> DataFrame:
    """Left-join display names from a (player_id, name) dimension."""
    return df.join(
        names.select(F.col("player_id").alias(id_col), F.initcap("name").alias(name_col)), id_col, "left"
    )


def missing_documents(expected: DataFrame, present: DataFrame, key: str = "game_id") -> DataFrame:
    """Keys that should have a document and do not."""
    return expected.select(key).where(F.col(key).isNotNull()).distinct().join(present.select(key), key, "left_anti")


def date_gaps(present: DataFrame, date: str, low, high) -> DataFrame:
    """Dates of ``[low, high]`` without any row."""
    spark = present.sparkSession
    low, high = (F.lit(v).cast("date") if not isinstance(v, Column) else v for v in (low, high))
    spine = spark.range(1).select(F.explode(F.sequence(low, high)).alias(date))
    return spine.join(present.select(F.to_date(date).alias(date)).distinct(), date, "left_anti")


def latest_scorable_date(games: DataFrame, odds: DataFrame, today=None, date: str = "game_date") -> DataFrame:
    """Newest game date not after ``today`` that also has odds (one row, NULL if none)."""
    df = games.select(date).distinct().join(odds.select(date).distinct(), date, "left_semi")
    if today is not None:
        df = df.where(F.col(date) <= F.lit(today).cast("date"))
    return df.agg(F.max(date).alias(date))
