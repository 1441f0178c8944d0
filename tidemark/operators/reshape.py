"""Wide/long conversions between one row per game and one row per side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

SIDES = (("home", "away"), ("away", "home"))


def explode_lineups(games: DataFrame) -> DataFrame:
    """One row per (game, side, slot) from the parallel line-up and position arrays."""
    has_pos = "home_lineup_positions" in games.columns

    def half(side: str) -> Column:
        ids = F.col(f"{side}_lineup")
        pos = F.col(f"{side}_lineup_positions") if has_pos else F.transform(ids, lambda _: F.lit(None).cast("string"))
        return F.struct(F.lit(side).alias("side"), F.arrays_zip(ids.alias("player_id"), pos.alias("position")).alias("slots"))

    halves = games.select("game_id", F.explode(F.array(half("home"), half("away"))).alias("h"))
    flat = halves.select("game_id", F.col("h.side").alias("side"), F.posexplode("h.slots").alias("p", "s"))
    fields = flat.schema["s"].dataType.names
    return flat.select(
        "game_id", "side", (F.col("p") + 1).alias("slot"),
        F.col(f"s.{fields[0]}").cast("long").alias("player_id"), F.col(f"s.{fields[1]}").alias("position"),
    )


def two_sides(games: DataFrame, per_side: dict[str, dict[str, Column]], keep: Sequence[str]) -> DataFrame:
    """Two rows per game in one pass: ``per_side[side][name]`` gives each side's columns."""
    halves = F.array(*[
        F.struct(F.lit(side).alias("side"), *[c.alias(n) for n, c in per_side[side].items()]) for side, _ in SIDES
    ])
    return games.select(*keep, F.explode(halves).alias("_h")).select(*keep, "_h.*")


def stack_sides(games: DataFrame) -> DataFrame:
    """Side-agnostic rows: own ``off_*``, the opponent's ``opp_sp_*`` and ``opp_bp_*``."""
    keep = [c for c in ("game_id", "game_date", "season_year", "home_name", "away_name") if c in games.columns]
    per_side = {}
    for side, opp in SIDES:
        cols = {
            "is_home": F.lit(1 if side == "home" else 0),
            "runs": F.col(f"{side}_score").cast("double"),
            "opponent_runs": F.col(f"{opp}_score").cast("double"),
        }
        for source, target in ((f"{side}_off_", "off_"), (f"{opp}_sp_", "opp_sp_"), (f"{opp}_bp_", "opp_bp_")):
            for c in games.columns:
                if c.startswith(source):
                    cols[target + c[len(source):]] = F.col(c).cast("double")
        per_side[side] = cols
    shared = sorted(set(per_side["home"]) & set(per_side["away"]))
    return two_sides(games, {s: {n: per_side[s][n] for n in shared} for s in per_side}, keep)


def fold_sides(long: DataFrame, key: str | Sequence[str], columns: Sequence[str], name=None, side: str = "side") -> DataFrame:
    """One row per key with ``<side>_<column>`` for both sides.

    Each side travels as one struct, so the aggregate has two buffers rather
    than two per column, and no distinct pass over pivot values is needed.
    """
    name = name or (lambda s, c: f"{s}_{c}")
    keys = [key] if isinstance(key, str) else list(key)
    packed = F.struct(*columns)
    folded = long.groupBy(*keys).agg(*[
        F.first(F.when(F.col(side) == s, packed), ignorenulls=True).alias(f"_{s}") for s, _ in SIDES
    ])
    return folded.select(*keys, *[F.col(f"_{s}.{c}").alias(name(s, c)) for s, _ in SIDES for c in columns])
