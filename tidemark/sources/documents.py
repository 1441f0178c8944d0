"""Nested JSON documents: outcomes, box scores, odds snapshots, schedules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators import rows
from tidemark.schemas import BOXSCORE_DOC, ODDS_DOC, OUTCOMES_DOC, SCHEDULE_DOC, parse

_BAD = "_corrupt_record"
_DAY_FOLDER = re.compile(r"(?:[A-Za-z_]+=)?(\d{4}-\d{2}-\d{2})")


def _documents(spark: SparkSession, paths: str | list[str], ddl: str, lines: bool = False, names: str = "*.json") -> DataFrame:
    """JSON under ``paths`` with its file path, a document to a file or to a line; malformed ones are skipped."""
    schema = parse(ddl).add(_BAD, "string")
    docs = (
        spark.read.schema(schema).option("multiLine", not lines).option("recursiveFileLookup", True)
        .option("pathGlobFilter", names).option("columnNameOfCorruptRecord", _BAD).json(paths)
    )
    return docs.where(F.col(_BAD).isNull()).drop(_BAD).withColumn("_path", F.col("_metadata.file_path"))


def parsed(texts: DataFrame, ddl: str, *keep: str, text: str = "doc") -> DataFrame:
    """Documents held as JSON text in a column, their top-level fields as columns beside ``keep``.

    The array of one document holds filters on its fields above the parser: below it, each would parse the text again.
    """
    return texts.select(*keep, F.inline(F.array(F.from_json(text, parse(ddl)))))


def _day_folders(spark: SparkSession, root: str, low: str | None, high: str | None) -> list[str]:
    """Folders ``<root>/<date>`` or ``<root>/<name>=<date>`` of the dates within the bounds. Only names below ``root`` are listed."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return []
    found = []
    for child in system.listStatus(place):
        day = _DAY_FOLDER.fullmatch(child.getPath().getName())
        if child.isDirectory() and day and (low is None or day[1] >= low) and (high is None or day[1] <= high):
            found.append(child.getPath().toString())
    return sorted(found)


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.json$", 1)


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Every game of every day document, all statuses."""
    return outcome_games(_documents(spark, path, OUTCOMES_DOC))


def outcome_games(docs: DataFrame) -> DataFrame:
    return docs.select(F.inline("data"))


def read_boxscores(spark: SparkSession, path: str) -> DataFrame:
    """One wide row per game; the game id is the file's stem."""
    docs = _documents(spark, path, BOXSCORE_DOC)
    return boxscore_lineups(docs.withColumn("game_id", _stem(F.col("_path")).try_cast("bigint")).withColumnRenamed("_path", "box_path"))


def _starting_positions(side: str) -> Column:
    """Map "ID<player>" -> first position played, else the last one listed."""
    return F.transform_values(
        F.col(f"{side}.players"),
        lambda _, p: F.coalesce(
            F.nullif(F.get(p["allPositions"], F.lit(0))["abbreviation"], F.lit("")), F.nullif(p["position"]["abbreviation"], F.lit(""))),
    )


def boxscore_lineups(docs: DataFrame) -> DataFrame:
    """Line-up, position and pitcher arrays of complete box scores.

    ``docs`` has the box-score structs plus ``game_id`` (and ``box_path``).
    """
    def size(c):
        return F.coalesce(F.size(c), F.lit(0))

    complete = F.lit(True)
    for s in ("home", "away"):
        complete = complete & (size(f"{s}.battingOrder") > 0) & (size(f"{s}.pitchers") > 0)
    docs = docs.where(complete & F.col("game_id").isNotNull())
    docs = docs.withColumns({f"_pos_{s}": _starting_positions(s) for s in ("home", "away")})
    none = F.array().cast("array<bigint>")

    def positions(s: str) -> Column:
        return F.transform(F.col(f"{s}.battingOrder"), lambda p: F.try_element_at(F.col(f"_pos_{s}"), F.concat(F.lit("ID"), p.cast("string"))))

    cols: dict[str, Column] = {"game_id_str": F.col("gameId")}
    for s in ("home", "away"):
        cols |= {
            f"{s}_team_id": F.col(f"{s}.team.id"), f"{s}_starter_id": F.get(f"{s}.pitchers", F.lit(0)),
            f"{s}_lineup": F.col(f"{s}.battingOrder"),
            f"{s}_lineup_positions": positions(s),
            f"{s}_pitchers_used": F.col(f"{s}.pitchers"), f"{s}_bullpen_pregame": F.coalesce(F.col(f"{s}.bullpen"), none),
        }
    cols["box_path"] = F.col("box_path") if "box_path" in docs.columns else F.lit(None).cast("string")
    return docs.select("game_id", *[c.alias(n) for n, c in cols.items()])


def player_names(docs: DataFrame) -> DataFrame:
    """(player_id, name) seen in box-score documents; the alphabetically last name wins."""
    sides = F.array(*[F.map_entries(F.coalesce(F.col(f"{s}.players"), F.expr("map()").cast(docs.schema["home"].dataType["players"].dataType))) for s in ("home", "away")])
    entries = docs.select(F.explode(F.flatten(sides)).alias("e"))
    flat = entries.select(
        F.regexp_replace("e.key", "^[ID]+", "").try_cast("bigint").alias("player_id"), F.col("e.value.person.fullName").alias("name"))
    return flat.where(F.col("player_id").isNotNull() & (F.col("name") != "")).groupBy("player_id").agg(F.max("name").alias("name"))


def upsert_player_names(existing: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """Known names overlaid with the newly seen ones, by id."""
    merged = fresh if existing is None else rows.replace_batch(existing, fresh, ["player_id"])
    return merged.select("player_id", "name")


def read_odds_snapshots(spark: SparkSession, root: str, low: str | None = None, high: str | None = None,
                        lines: bool = False, names: str = "*.json") -> DataFrame:
    """Long quotes of the snapshots in the folders of the dates within the bounds (``_day_folders``); no rows if there are none.

    Without bounds all of ``root`` is read, with them folders of other dates are neither listed nor read. With ``lines`` a file
    holds a snapshot on each line, as archives of many do; ``names`` is the pattern of the files.
    """
    from tidemark.sources.tables import folder_exists

    bounded = low is not None or high is not None
    found = _day_folders(spark, root, low, high) if bounded else [root] if folder_exists(spark, root) else []
    if not found:
        return quotes_long(spark.createDataFrame([], parse(ODDS_DOC)).withColumn("source", F.lit("")))
    return quotes_long(_documents(spark, found, ODDS_DOC, lines, names).withColumnRenamed("_path", "source"))


def quotes_long(docs: DataFrame) -> DataFrame:
    """One row per (snapshot, game, book) with both sides' head-to-head prices."""
    game = docs.select(F.to_timestamp("fetched_at_utc").alias("snapshot_ts"), "source", F.explode("data").alias("g"))
    book = game.select("snapshot_ts", "source", "g", F.explode("g.bookmakers").alias("b"))
    h2h = F.get(F.filter("b.markets", lambda m: m["key"] == "h2h"), F.lit(0))
    flat = book.select("snapshot_ts", "source", "g", "b", h2h.alias("m")).where(F.col("m").isNotNull())

    def price(team: str) -> Column:
        # The last outcome of a name counts, as when outcomes are read into a map.
        named = F.filter("m.outcomes", lambda o: o["name"] == F.col(f"g.{team}"))
        return F.try_element_at(named, F.lit(-1))["price"]

    out = flat.select(
        "snapshot_ts", "source", F.to_timestamp("g.commence_time").alias("commence_time"), F.col("g.id").alias("odds_api_game_id"),
        F.col("g.home_team").alias("home_team"), F.col("g.away_team").alias("away_team"), F.col("b.key").alias("book_key"),
        F.col("b.title").alias("book_title"), F.to_timestamp("m.last_update").alias("last_update"),
        price("home_team").alias("home_price_american"), price("away_team").alias("away_price_american"))
    return out.where(F.col("home_price_american").isNotNull() & F.col("away_price_american").isNotNull())


def schedule_games(docs: DataFrame) -> DataFrame:
    return docs.select(F.inline("data")).withColumns({
        "game_date": F.to_date("game_date"), "game_datetime": F.expr("try_to_timestamp(game_datetime)")})


def read_schedule(spark: SparkSession, root: str, day: str) -> DataFrame:
    """Games of one day's schedule document ``<day>.json`` in ``root`` or a folder of it; no rows when the day has none.

    The pattern picks the document while listing, so no other is opened.
    """
    return schedule_games(_documents(spark, root, SCHEDULE_DOC, names=f"{day}.json"))
