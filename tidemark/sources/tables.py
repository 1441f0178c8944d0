"""Parquet tables: event log, reference dims, feature sinks, incremental appends."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark import constants as K
from tidemark.operators import rows
from tidemark.schemas import EVENTS, OAA, PARK_FACTORS, align, parse
from tidemark.session import stage


def read_events(spark: SparkSession, root: str, years: Sequence[int]) -> DataFrame:
    """Seasons of the event log (folders ``game_year=<year>``); a missing season is an error."""
    paths = [f"{root.rstrip('/')}/game_year={int(y)}" for y in years]
    return spark.read.schema(parse(EVENTS)).option("basePath", root).parquet(*paths)


def read_table(spark: SparkSession, path: str, ddl: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.schema(parse(ddl)).parquet(path)
    return df.select(*columns) if columns else df


def read_oaa(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, OAA)


def read_park_factors(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, PARK_FACTORS)


def write_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Idempotent overwrite of just the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_feature_table(df: DataFrame, path: str, season: str = "season_year") -> None:
    write_partitions(df.hint("rebalance", season), path, [season])


def write_day_partition(games: DataFrame, path: str, day: str, sport: str, fetched_at: Column | None = None) -> None:
    """Store a day's games with capture metadata; days without games write nothing."""
    stamped = games.withColumns({
        "fetched_at_utc": F.current_timestamp() if fetched_at is None else fetched_at, "sport": F.lit(sport), "day": F.lit(day)})
    write_partitions(stamped, path, ["day"])


def save_snapshot(df: DataFrame, path: str, taken_at: str) -> None:
    write_partitions(df.withColumn("snapshot_ts", F.lit(taken_at)), path, ["snapshot_ts"])


def read_latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Newest saved version; the partition filter is a subquery, so only it is scanned."""
    versions = spark.read.parquet(path).withColumn("snapshot_ts", F.col("snapshot_ts").cast("string"))
    newest = versions.agg(F.max("snapshot_ts"))
    return versions.where(F.col("snapshot_ts") == newest.scalar())


def append_dedupe(existing: DataFrame, fresh: DataFrame, keys: Sequence[str] = K.PITCH_DEDUPE_KEYS,
                  date: str = "game_date", until: str | None = None) -> DataFrame:
    """Existing rows plus fresh rows newer than the stored high-water date, last row per key.

    Fresh rows beat stored ones; inside a batch the later date wins, then a stable hash of the row. Stored rows are unique
    already, so only the batch is ordered; of the stored ones those go whose key comes again.
    """
    mark = existing.agg(F.max(F.to_date(date)))
    newer = fresh.where(F.to_date(date) > F.coalesce(mark.scalar(), F.lit("0001-01-01").cast("date")))
    if until is not None:
        newer = newer.where(F.to_date(date) <= F.lit(until).cast("date"))
    present = [k for k in keys if k in existing.columns or k in newer.columns]
    newer = newer.withColumns({c: F.lit(None).cast(existing.schema[c].dataType) for c in existing.columns if c not in newer.columns})
    batch = rows.keep_last(newer.withColumn("_tie", F.xxhash64(*existing.columns)), present, [date, "_tie"]).drop("_tie")
    same = reduce(lambda a, b: a & b, [F.col(f"_old.{k}").eqNullSafe(F.col(f"_new.{k}")) for k in present])
    kept = existing.alias("_old").join(batch.select(*present).alias("_new"), same, "left_anti")
    return kept.unionByName(batch, allowMissingColumns=True)


def stored_months(spark: SparkSession, root: str) -> list[str]:
    """Months (``yyyy-MM``) a table of ``append_stored`` has folders for, from their names alone."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []
    return sorted(n.split("=", 1)[1] for n in names if n.startswith("month=") and len(n) == len("month=yyyy-MM"))


def append_stored(fresh: DataFrame, root: str, keys: Sequence[str] = K.PITCH_DEDUPE_KEYS, date: str = "game_date", until: str | None = None) -> list[str]:
    """``append_dedupe`` into a stored table of month folders; the months written, oldest first.

    The high-water date is that of the newest folder. Of the older rows only those within the batch's smallest and largest keys
    are looked at, a filter that reaches the Parquet statistics, and only months that hold a key of the batch are copied. Older
    months lose replaced rows before the batch is written, so a call that broke off is made good by calling it again with the same rows.
    Rows without a date are never newer and stay out; NULL keys are keys.
    """
    spark = fresh.sparkSession
    months, month = stored_months(spark, root), F.date_format(F.to_date(date), "yyyy-MM")
    stored = spark.read.schema(fresh.schema).parquet(*[f"{root}/month={m}" for m in months]) if months else fresh.limit(0)
    newer = fresh.where(F.to_date(date).isNotNull())
    if months:
        mark = spark.read.schema(fresh.schema).parquet(f"{root}/month={months[-1]}").agg(F.max(F.to_date(date)).alias("d")).first()["d"]
        newer = newer.where(F.to_date(date) > F.lit(mark))
    if until is not None:
        newer = newer.where(F.to_date(date) <= F.lit(until).cast("date"))
    batch = stage(rows.keep_last(newer.withColumn("_tie", F.xxhash64(*fresh.columns)), list(keys), [date, "_tie"]).drop("_tie"), "batch")
    own = sorted(r[0] for r in batch.select(month.alias("m")).distinct().collect())  # as many as the calendar has
    if not own:
        return []
    ends = batch.agg(*[f(k).alias(f"{n}{i}") for i, k in enumerate(keys) for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count))],
                     F.count(F.lit(1)).alias("rows")).first()

    def within(i: int, k: str) -> Column:
        inside = F.col(k).between(F.lit(ends[f"lo{i}"]), F.lit(ends[f"hi{i}"])) if ends[f"n{i}"] else F.lit(False)
        return inside | F.col(k).isNull() if ends[f"n{i}"] < ends["rows"] else inside

    again = reduce(lambda a, b: a & b, [F.col(f"_old.{k}").eqNullSafe(F.col(f"_new.{k}")) for k in keys])

    def met(df: DataFrame, how: str) -> DataFrame:
        return df.alias("_old").join(batch.select(*keys).alias("_new"), again, how)

    near = stored.where(reduce(lambda a, b: a & b, [within(i, k) for i, k in enumerate(keys)]))
    old = sorted({r[0] for r in met(near, "left_semi").select(month.alias("m")).distinct().collect()} - set(own))

    def kept(of: list[str]) -> DataFrame:
        known = [f"{root}/month={m}" for m in of if m in months]
        return met(spark.read.schema(fresh.schema).parquet(*known), "left_anti") if known else fresh.limit(0)

    if old:
        left = stage(kept(old).withColumn("month", month), "kept")
        files = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        for m in set(old) - {r[0] for r in left.select("month").distinct().collect()}:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/month={m}"), True)
        write_partitions(left, root, ["month"])
    write_partitions(stage(kept(own).unionByName(batch).withColumn("month", month), "appended"), root, ["month"])
    return [*old, *own]


def folder_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Small report sink in Parquet or CSV."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def stack_bat_sides(right: DataFrame, left: DataFrame, fetched_year: int) -> DataFrame:
    """Park-factor slices by batter side, numbers cast leniently."""
    both = rows.tagged_union({"R": right, "L": left}, "bat_side")
    schema = parse(PARK_FACTORS)
    text = {"bat_side", "venue_name", "name_display_club", "year_range"}
    casts = {c: F.col(c).cast("string").try_cast(schema[c].dataType) for c in both.columns if c in schema.names and c not in text}
    return align(both.withColumns(casts).withColumn("fetched_year", F.lit(fetched_year)), PARK_FACTORS)


def stack_fielding(slices: dict[int, DataFrame]) -> DataFrame:
    """Fielding rows by position code, with the abbreviation and implied attempts."""
    from tidemark.functions.text_time import attempts_from_rates

    both = rows.tagged_union(slices, "position_code")
    table = F.create_map(*[F.lit(v) for pair in K.POSITION_CODES.items() for v in pair])
    both = both.withColumns({
        "position_abbrev": F.try_element_at(table, F.col("position_code")), "player_id": F.col("player_id").cast("string").try_cast("bigint"),
        "attempts": attempts_from_rates(F.col("outs_above_average").cast("string"), F.col("diff_success_rate_formatted"))})
    return align(both, OAA)
