"""Ridge run model: exact medians, one distributed Gram matrix, a small solve."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark import constants as K
from tidemark.operators import reshape, scan
from tidemark.schemas import MODEL


def impute_medians(stacked: DataFrame, features: Sequence[str]) -> dict[str, float | None]:
    """Exact median per feature (one value each, so it fits a dict)."""
    medians = scan.exact_quantiles(scan.melt(stacked, features), [0.5]).collect()
    found = {r["key"]: r["q"][0] for r in medians}
    return {f: found.get(f) for f in features}


def design_matrix(stacked: DataFrame, features: Sequence[str], impute: dict[str, float | None]) -> DataFrame:
    """Replace missing features by the stored medians."""
    return stacked.withColumns({
        f: F.coalesce(F.col(f).cast("double"), F.lit(impute[f]).cast("double")) for f in features
    })


def gram(design: DataFrame, features: Sequence[str], target: str, shift: dict[str, float | None]) -> tuple[np.ndarray, np.ndarray]:
    """(G, centre) with ``G = Z'Z`` over ``Z = [1, x - centre, y]``.

    Every Arrow batch is reduced to a small matrix inside its task and only those
    cells are shuffled; centring on the medians keeps the sums well conditioned.
    """
    columns = [*features, target]
    centre = np.array([shift.get(f) or 0.0 for f in features] + [0.0])

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(columns) + 1, len(columns) + 1))
        for batch in batches:
            z = np.column_stack([np.ones(len(batch)), batch[columns].to_numpy(dtype=float) - centre])
            total += z.T @ z
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    cells = design.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(reduce, "i int, j int, v double")
    out = np.zeros((len(columns) + 1, len(columns) + 1))
    for row in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # (p + 2)^2 cells
        out[row["i"], row["j"]] = row["v"]
    return out, centre


def solve(g: np.ndarray, centre: np.ndarray, features: Sequence[str], chosen: Sequence[str], alpha: float) -> dict:
    """Ridge on standardised features with an unpenalised intercept, from the Gram matrix."""
    n = g[0, 0]
    mean = g[0] / n
    cov = g / n - np.outer(mean, mean)
    at = [1 + list(features).index(f) for f in chosen]
    target = len(features) + 1
    scale = np.sqrt(np.clip(np.diag(cov)[at], 0.0, None))
    scale = np.where(scale > 1e-12 * (1.0 + np.abs(mean[at])), scale, 1.0)
    x = cov[np.ix_(at, at)] / np.outer(scale, scale)
    y = cov[at, target] / scale
    coef = np.linalg.solve(n * x + alpha * np.eye(len(at)), n * y)
    y_mean = mean[target] + centre[-1]
    return {
        "n": int(n), "mean": mean[at] + centre[[i - 1 for i in at]], "scale": scale, "coef": coef,
        "intercept": float(y_mean), "target_mean": float(y_mean), "target_std": float(np.sqrt(max(cov[target, target], 0.0))),
    }


def fit_many(stacked: DataFrame, feature_sets: dict[str, Sequence[str]], *, target: str = "runs",
             alpha: float = K.RIDGE_ALPHA) -> DataFrame:
    """Parameter table of several feature sets from one pass over their union."""
    union = list(dict.fromkeys(f for s in feature_sets.values() for f in s))
    known = stacked.where(F.col(target).isNotNull())
    impute = impute_medians(known, union)
    g, centre = gram(design_matrix(known, union, impute), union, target, impute)
    records = []
    for name, chosen in feature_sets.items():
        fit = solve(g, centre, union, chosen, alpha)
        for i, f in enumerate(chosen):
            records.append((name, f, i, impute[f], float(fit["mean"][i]), float(fit["scale"][i]), float(fit["coef"][i]),
                            fit["intercept"], fit["n"], fit["target_mean"], fit["target_std"]))
    return stacked.sparkSession.createDataFrame(records, MODEL)


def window_medians(known: DataFrame, features: Sequence[str], season: str, windows: Sequence[int]) -> dict[int, dict[str, float]]:
    """Exact medians of the features over every expanding window: all seasons up to and including each of ``windows``.

    Different values are counted per season first; a count then stands in every window that holds its season.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    counted = known.select(season, F.explode(pairs).alias("p")).where(F.col("p.value").isNotNull()).groupBy(season, "p.feature", "p.value").agg(
        F.count(F.lit(1)).alias("n"))
    ends = F.filter(F.array(*[F.lit(w) for w in windows]), lambda w: w >= F.col(season))
    spread = counted.withColumn("window", F.explode(ends)).select(F.struct("window", "feature").alias("key"), "value", "n")
    out: dict[int, dict[str, float]] = {w: {} for w in windows}
    for row in scan.exact_quantiles(spread, [0.5], weight="n").collect():  # windows x features
        out[row["key"]["window"]][row["key"]["feature"]] = row["q"][0]
    return out


def season_grams(known: DataFrame, features: Sequence[str], target: str, season: str, centre: np.ndarray) -> dict[int, np.ndarray]:
    """Gram matrices by season over ``[1, (x - centre) or 0, missing, y]``: whatever a window imputes follows from them."""
    columns = [season, *features, target]
    size = 2 * len(features) + 2

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch[list(features)].to_numpy(dtype=float) - centre
            missing = np.isnan(x)
            z = np.column_stack([np.ones(len(batch)), np.where(missing, 0.0, x), missing, batch[target].to_numpy(dtype=float)])
            years = batch[season].to_numpy()
            for year in np.unique(years).tolist():
                own = z[years == year]
                total[year] = total.get(year, 0.0) + own.T @ own
        i, j = (a.ravel() for a in np.indices((size, size)))
        for year, g in total.items():
            yield pd.DataFrame({"season": year, "i": i, "j": j, "v": g.ravel()})

    rows = known.select(F.col(season).cast("int").alias(season), *[F.col(c).cast("double").alias(c) for c in columns[1:]])
    cells = rows.mapInPandas(reduce, "season int, i int, j int, v double").groupBy("season", "i", "j").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for row in cells.collect():  # seasons x (2 p + 2)^2 cells
        out.setdefault(row["season"], np.zeros((size, size)))[row["i"], row["j"]] = row["v"]
    return out


def fit_windows(stacked: DataFrame, feature_sets: dict[str, Sequence[str]], *, season: str = "season_year", target: str = "runs",
                windows: Sequence[int] | None = None, alpha: float = K.RIDGE_ALPHA) -> DataFrame:
    """Parameter tables (``through`` and the columns of a model) of every feature set on every expanding window of seasons.

    The rows are read once for the medians and once for Gram matrices keyed by season; a window's matrix is a prefix sum
    of them, and each set is solved from its part of it. Rows without the target or season take no part.
    """
    union = list(dict.fromkeys(f for s in feature_sets.values() for f in s))
    known = stacked.where(F.col(target).isNotNull() & F.col(season).isNotNull())
    if windows is None:
        windows = sorted(r[0] for r in known.select(F.col(season).cast("int")).distinct().collect())  # one row for each season
    medians = window_medians(known, union, season, windows)
    widest = medians[max(windows)]
    centre = np.array([widest.get(f) or 0.0 for f in union])
    grams = season_grams(known, union, target, season, centre)
    p = len(union)
    records = []
    for through in windows:
        parts = [g for year, g in grams.items() if year <= through]
        if not parts:
            continue
        impute = {f: medians[through].get(f) for f in union}
        t = np.zeros((2 * p + 2, p + 2))  # from the keyed columns to [1, x - centre, y], missing ones imputed
        t[0, 0] = t[-1, -1] = 1.0
        for k, f in enumerate(union):
            t[1 + k, 1 + k] = 1.0
            t[1 + p + k, 1 + k] = (impute[f] if impute[f] is not None else centre[k]) - centre[k]
        g = t.T @ sum(parts) @ t
        for name, chosen in feature_sets.items():
            fit = solve(g, np.append(centre, 0.0), union, chosen, alpha)
            records += [(through, name, f, i, impute[f], float(fit["mean"][i]), float(fit["scale"][i]), float(fit["coef"][i]), fit["intercept"],
                         fit["n"], fit["target_mean"], fit["target_std"]) for i, f in enumerate(chosen)]
    return stacked.sparkSession.createDataFrame(records, "through int, " + MODEL)


def score_models(stacked: DataFrame, models: DataFrame, out: str = "runs_pred") -> DataFrame:
    """Every row under every model of ``fit_windows`` (``through``, ``feature_set``, ``train_n``, ``n_feat``).

    The parameters are one literal array that the rows are exploded by; a term for each feature then serves all models. A formula
    for each model made code too large to be compiled, by the driver or by the executors.
    """
    by_model: dict[tuple, list] = {}
    for r in sorted(models.collect(), key=lambda r: (r["through"], r["feature_set"], r["position"])):
        by_model.setdefault((r["through"], r["feature_set"]), []).append(r)
    union = list(dict.fromkeys(r["feature"] for params in by_model.values() for r in params))

    def double(value: float | None) -> Column:
        return F.lit(value).cast("double")

    def model(through: int, name: str, params: list) -> Column:
        own = {r["feature"]: r for r in params}
        terms = [F.struct(*[double(own[f][c] if f in own else None).alias(c) for c in ("impute", "mean", "scale", "coef")]).alias(f"t{i}") for i, f in enumerate(union)]
        return F.struct(F.lit(through).alias("through"), F.lit(name).alias("feature_set"), F.lit(len(params)).alias("n_feat"),
                        F.lit(params[0]["train_n"]).alias("train_n"), double(params[0]["intercept"]).alias("intercept"), *terms)

    each = stacked.withColumn("_m", F.explode(F.array(*[model(*key, params) for key, params in by_model.items()])))
    total = F.col("_m.intercept")
    for i, f in enumerate(union):
        t = F.col(f"_m.t{i}")
        term = (F.coalesce(F.col(f).cast("double"), t["impute"]) - t["mean"]) / t["scale"] * t["coef"]
        total = total + F.when(t["coef"].isNotNull(), term).otherwise(0.0)
    return each.select(*stacked.columns, *[f"_m.{c}" for c in ("through", "feature_set", "n_feat", "train_n")], total.alias(out))


def fit_ridge(stacked: DataFrame, features: Sequence[str] = K.FEATURES_DEFAULT, **options) -> DataFrame:
    return fit_many(stacked, {"model": features}, **options)


def train_runs_model(games: DataFrame, features: Sequence[str] = K.FEATURES_DEFAULT, **options) -> DataFrame:
    """Fit on both sides of every game with a known score."""
    return fit_ridge(reshape.stack_sides(games), features, **options)


def score(stacked: DataFrame, model: DataFrame, out: str = "runs_pred") -> DataFrame:
    """Linear score as one Column; the parameter table has one row per feature, of one feature set."""
    params = sorted(model.collect(), key=lambda r: r["position"])
    if len({r["feature_set"] for r in params}) != 1:
        raise ValueError("score takes the parameters of one feature set")
    total = F.lit(params[0]["intercept"])
    for r in params:
        x = F.coalesce(F.col(r["feature"]).cast("double"), F.lit(r["impute"]).cast("double"))
        total = total + (x - F.lit(r["mean"])) / F.lit(r["scale"]) * F.lit(r["coef"])
    return stacked.withColumn(out, total)


def predict_runs(games: DataFrame, model: DataFrame, home_bonus: float = K.HOME_RUNS_BONUS) -> DataFrame:
    """Projected runs of both sides, the home bonus added."""
    long = score(reshape.stack_sides(games), model).select("game_id", "side", "runs_pred")
    wide = reshape.fold_sides(long, "game_id", ["runs_pred"], lambda s, _: f"{s}_runs_pred")
    wide = wide.withColumn("home_runs_pred", F.col("home_runs_pred") + home_bonus)
    return games.join(wide, "game_id", "left")


def coefficient_table(model: DataFrame) -> DataFrame:
    """Standardised coefficients, largest magnitude first."""
    return model.select("feature_set", "feature", F.col("coef").alias("coef_std")).orderBy(
        "feature_set", F.abs("coef_std").desc(), "feature")


def save_model(model: DataFrame, path: str) -> None:
    model.coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark, path: str) -> DataFrame:
    from tidemark.schemas import parse

    return spark.read.schema(parse(MODEL)).parquet(path)
