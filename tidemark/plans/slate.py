"""From run predictions to a priced slate and its report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark import constants as K
from tidemark.functions.rates import pythag
from tidemark.operators import bets, evaluate, odds, reshape, ridge

EV_DIGITS = 8


def predict_games(games: DataFrame, model: DataFrame, *, home_bonus: float = K.HOME_RUNS_BONUS,
                  exponent: float = K.PYTHAG_EXPONENT) -> DataFrame:
    """Add projected runs and the home win probability."""
    out = ridge.predict_runs(games, model, home_bonus)
    return out.withColumn("p_home", pythag(F.col("home_runs_pred"), F.col("away_runs_pred"), exponent))


def price_slate(predicted: DataFrame, lines: DataFrame, *, require_odds: bool = True, **betting) -> DataFrame:
    """Join the lines, annotate both sides and keep the slate columns present.

    With ``require_odds`` off, games without both prices stay, their betting columns NULL.
    """
    joined = odds.join_slate(predicted, lines, require_odds=require_odds)
    both = F.col("home_price_american").isNotNull() & F.col("away_price_american").isNotNull()
    annotated = bets.annotate_bets(joined.where(both), **betting)
    slate = annotated.select(*[c for c in K.SLATE_COLUMNS if c in annotated.columns])
    if require_odds:
        return slate
    unpriced = joined.where(~both)
    return slate.unionByName(unpriced.select(*[c for c in slate.columns if c in unpriced.columns]), allowMissingColumns=True)


def predict_slate(games: DataFrame, model: DataFrame, lines: DataFrame, *, home_bonus: float = K.HOME_RUNS_BONUS,
                  exponent: float = K.PYTHAG_EXPONENT, **options) -> DataFrame:
    return price_slate(predict_games(games, model, home_bonus=home_bonus, exponent=exponent), lines, **options)


def slate_report(slate: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recommended bets by EV, full slate by start time with a verdict).

    Equal values may differ in their last bits, so the order goes by the EV rounded to ``EV_DIGITS``, then by ``game_id``.
    """
    home = F.col("recommended") == "home"

    def side(h: str, a: str):
        return F.when(home, F.col(h)).otherwise(F.col(a))

    matchup = F.concat_ws(" @ ", "away_name", "home_name")
    chosen = slate.where(F.col("recommended").isin("home", "away")).select(
        "game_id", matchup.alias("game"), F.upper("recommended").alias("side"), side("home_name", "away_name").alias("team"),
        side("home_book", "away_book").alias("book"), side("home_price_american", "away_price_american").alias("odds"),
        F.when(home, F.col("p_home")).otherwise(1.0 - F.col("p_home")).alias("model_p"),
        side("home_fair_p", "away_fair_p").alias("fair_p"), side("edge_home", "edge_away").alias("edge"),
        F.col("recommended_ev").alias("ev"), F.col("recommended_kelly").alias("kelly"),
    ).orderBy(F.round("ev", EV_DIGITS).desc(), "game_id")
    verdict = F.when(F.col("recommended") != "", F.concat(F.lit("bet "), F.upper("recommended"))).otherwise("no bet")
    extra = []
    if "home_lineup_source" in slate.columns:
        tag = [F.when(F.col(f"{s}_lineup_source") == "actual", "A").otherwise("P") for s in ("away", "home")]
        extra = [F.concat_ws("/", *tag).alias("lineups")]
    full = slate.select("game_id", "commence_time", matchup.alias("game"), *extra, "away_runs_pred", "home_runs_pred", "p_home",
                        "home_fair_p", verdict.alias("verdict")).orderBy("commence_time", "game_id")
    return chosen, full


def ablation(train: dict[str, DataFrame], holdout: DataFrame, feature_sets: dict[str, Sequence[str]], *,
             alpha: float = K.RIDGE_ALPHA, home_bonus: float = K.HOME_RUNS_BONUS) -> DataFrame:
    """One metric row per (training split, feature set), all scored on one holdout.

    Each split is read once for all its feature sets; the holdout is scored by
    every model in one projection.
    """
    from tidemark.operators.rows import union_all

    stacked_holdout = reshape.stack_sides(holdout)
    results = []
    for split, games in train.items():
        models = ridge.fit_many(reshape.stack_sides(games), feature_sets, alpha=alpha)
        sizes = {r["feature_set"]: r["train_n"] for r in models.select("feature_set", "train_n").distinct().collect()}
        scored = stacked_holdout
        for name in feature_sets:
            scored = ridge.score(scored, models.where(F.col("feature_set") == name), f"pred_{name}")
        wide = reshape.fold_sides(scored, "game_id", ["runs", *[f"pred_{n}" for n in feature_sets]])
        for name, features in feature_sets.items():
            h, a = F.col(f"home_pred_{name}") + home_bonus, F.col(f"away_pred_{name}")
            games_scored = wide.where(F.col("home_runs").isNotNull() & F.col("away_runs").isNotNull()).select(
                "home_runs", "away_runs", h.alias("home_runs_pred"), a.alias("away_runs_pred"),
                (F.col("home_runs") > F.col("away_runs")).cast("int").alias("home_win"), pythag(h, a).alias("p_home"),
                F.lit(split).alias("split"), F.lit(name).alias("feature_set"), F.lit(len(features)).alias("n_feat"),
                F.lit(int(sizes[name])).alias("train_n"))
            results.append(games_scored)
    keys = ["split", "feature_set", "n_feat", "train_n"]
    every = union_all(results)
    mae = every.groupBy(*keys).agg(
        ((F.avg(F.abs(F.col("home_runs_pred") - F.col("home_runs"))) + F.avg(F.abs(F.col("away_runs_pred") - F.col("away_runs")))) / 2).alias("mae"))
    return evaluate.classification_metrics(every, "home_win", "p_home", keys).join(mae, keys)


def expanding_ablation(games: DataFrame, holdout: DataFrame, feature_sets: dict[str, Sequence[str]], *, season: str = "season_year",
                       windows: Sequence[int] | None = None, alpha: float = K.RIDGE_ALPHA, home_bonus: float = K.HOME_RUNS_BONUS) -> DataFrame:
    """One metric row per (expanding window of seasons, feature set), all scored on one holdout.

    All models come from one pass of keyed Gram matrices; the holdout is read once and scored by all of them in one plan.
    """
    models = ridge.fit_windows(reshape.stack_sides(games), feature_sets, season=season, windows=windows, alpha=alpha)
    keys = ["through", "feature_set", "n_feat", "train_n"]
    scored = ridge.score_models(reshape.stack_sides(holdout), models)
    wide = reshape.fold_sides(scored, ["game_id", *keys], ["runs", "runs_pred"])
    h, a = F.col("home_runs_pred") + home_bonus, F.col("away_runs_pred")
    known = wide.where(F.col("home_runs").isNotNull() & F.col("away_runs").isNotNull()).withColumns({
        "home_win": (F.col("home_runs") > F.col("away_runs")).cast("int"), "p_home": pythag(h, a),
        "miss": (F.abs(h - F.col("home_runs")) + F.abs(a - F.col("away_runs"))) / 2})
    return evaluate.classification_metrics(known, "home_win", "p_home", keys).join(known.groupBy(*keys).agg(F.avg("miss").alias("mae")), keys)
