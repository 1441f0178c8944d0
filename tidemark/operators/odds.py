"""Quotes: latest snapshot before the cutoff, best lines, team keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import constants as K
from tidemark.functions.text_time import eastern_date
from tidemark.operators import rows

GAME_KEYS = ("commence_time", "home_team", "away_team")


def quote_filters(quotes: DataFrame, books: Sequence[str] | None = K.DEFAULT_BOOKS,
                  extreme: float | None = K.EXTREME_PRICE) -> DataFrame:
    """Allowed books with both prices inside the plausible range."""
    if books is not None:
        quotes = quotes.where(F.col("book_key").isin(*books))
    return quotes if extreme is None else quotes.where(_plausible(extreme))


def _plausible(extreme: float) -> Column:
    return (F.abs("home_price_american") <= extreme) & (F.abs("away_price_american") <= extreme)


def before_cutoff(quotes: DataFrame, minutes: int = K.CLOSE_MINUTES) -> DataFrame:
    cutoff = F.col("commence_time") - F.make_interval(mins=F.lit(minutes))
    return quotes.where(F.col("snapshot_ts") <= cutoff)


def latest_before_cutoff(quotes: DataFrame, keys: Sequence[str] = GAME_KEYS, minutes: int = K.CLOSE_MINUTES) -> DataFrame:
    """Quotes of each game's latest snapshot at or before its cutoff.

    The chosen time is an aggregate joined back, not a window, so a game with
    very many quotes is never gathered in one task.
    """
    pre = before_cutoff(quotes, minutes)
    chosen = pre.groupBy(*keys).agg(F.max("snapshot_ts").alias("snapshot_ts"))
    return pre.join(chosen, [*keys, "snapshot_ts"], "left_semi")


def best_lines(quotes: DataFrame, *, minutes: int = K.CLOSE_MINUTES, strategy: str = "best",
               drop_extreme: bool = True, extreme: float = K.EXTREME_PRICE,
               books: Sequence[str] | None = K.DEFAULT_BOOKS, keys: Sequence[str] = GAME_KEYS) -> DataFrame:
    """One pre-game line per game from its latest snapshot before the cutoff.

    The snapshot is chosen before implausible prices are dropped; a game whose
    chosen snapshot has none left disappears. Quotes collapse per (game, snapshot)
    first, with map-side partial sums, and the latest collapsed row wins. The best
    price's book is the alphabetically first among equals.
    """
    if strategy not in ("best", "median", "mean"):
        raise ValueError(f"unknown price strategy: {strategy!r}")
    ok = _plausible(extreme) if drop_extreme else F.lit(True)
    home, away = (F.when(ok, F.col(f"{s}_price_american")) for s in ("home", "away"))
    aggs = {"_ok": F.count_if(ok), "n_books": F.count_distinct(F.when(ok, F.col("book_key")))}
    if strategy == "best":
        for side, price in (("home", home), ("away", away)):
            aggs[f"_{side}"] = F.min(F.when(price.isNotNull(), F.struct((-price).alias("neg"), F.col("book_title").alias("book"))))
    else:
        # Prices inside the plausible range are whole numbers, so the exact
        # median's buffer is bounded by that range.
        fold = F.median if strategy == "median" else F.avg
        aggs |= {"_home": fold(home), "_away": fold(away)}
    per_snapshot = before_cutoff(quote_filters(quotes, books, None), minutes).groupBy(*keys, "snapshot_ts").agg(
        *[c.alias(n) for n, c in aggs.items()])
    latest = rows.keep_last(per_snapshot, list(keys), ["snapshot_ts"]).where(F.col("_ok") > 0)
    none = F.lit(None).cast("string")
    if strategy == "best":
        priced = {s: ((-F.col(f"_{s}.neg")), F.col(f"_{s}.book")) for s in ("home", "away")}
    else:
        priced = {s: (F.col(f"_{s}"), none) for s in ("home", "away")}
    return latest.select(
        *keys, "snapshot_ts", F.col("n_books").cast("int").alias("n_books"),
        priced["home"][0].alias("home_price_american"), priced["away"][0].alias("away_price_american"),
        priced["home"][1].alias("home_book"), priced["away"][1].alias("away_book"),
    )


def team_keys(games: DataFrame) -> DataFrame:
    """(name, id) of every team, from both sides of a games table."""
    pairs = F.array(*[F.struct(F.col(f"{s}_name").alias("name"), F.col(f"{s}_id").cast("long").alias("id")) for s in ("home", "away")])
    distinct = games.select(F.explode(pairs).alias("p")).select("p.*").dropna().distinct()
    return rows.keep_last(distinct, ["name"], ["id"])


def attach_team_ids(lines: DataFrame, teams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines with both ids, rejected lines whose names do not resolve)."""
    out = lines
    for side in ("home", "away"):
        key = teams.select(F.col("name").alias(f"{side}_team"), F.col("id").alias(f"{side}_id"))
        out = out.join(key, f"{side}_team", "left")
    resolved = F.col("home_id").isNotNull() & F.col("away_id").isNotNull()
    return out.where(resolved), out.where(~resolved)


def with_game_date(lines: DataFrame) -> DataFrame:
    """Calendar date of the game: New York date of the UTC start."""
    return lines.withColumn("game_date", eastern_date(F.col("commence_time")))


def join_slate(games: DataFrame, lines: DataFrame, *, require_odds: bool = True) -> DataFrame:
    """Games with their line on (date, both teams); the later start wins for a repeated pair. Of a repeated game the
    earliest date counts, then the smallest hash of the row.

    With ``require_odds`` off, unmatched games stay with NULL prices.
    """
    keys = ["game_date", "home_id", "away_id"]
    keep = [c for c in ("commence_time", "snapshot_ts", "n_books", "home_price_american", "away_price_american",
                        "home_book", "away_book") if c in lines.columns]
    dated = with_game_date(lines).select(*keys, *keep)
    odds = rows.keep_last(dated, keys, ["commence_time", *[c for c in ("snapshot_ts", "home_price_american") if c in keep]])
    g = games.withColumns({"game_date": F.to_date("game_date"), "home_id": F.col("home_id").cast("long"),
                           "away_id": F.col("away_id").cast("long")})
    g = g.drop(*[c for c in keep if c in g.columns])
    g = rows.keep_first(g.withColumn("_tie", F.xxhash64(*g.columns)), ["game_id"], ["game_date", "_tie"]).drop("_tie")
    return g.join(odds, keys, "inner" if require_odds else "left")
