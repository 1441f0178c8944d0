"""Model checks: error, classification, calibration and coverage tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark import constants as K
from tidemark.operators import scan


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """n, MAE, RMSE, R2 and bias over rows with both values, in one pass."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    both = df.where(a.isNotNull() & p.isNotNull())
    err = p - a
    sse, sst = F.sum(err * err), F.var_pop(a) * F.count(F.lit(1))
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        (1.0 - sse / F.when(sst != 0, sst).otherwise(F.lit(K.PROB_EPS))).alias("r2"), F.avg(err).alias("bias"),
    )


def classification_metrics(df: DataFrame, label: str, prob: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, log-loss, Brier score, base rate and mean probability."""
    y = F.col(label).cast("double")
    raw = F.col(prob).cast("double")
    both = df.where(y.isNotNull() & raw.isNotNull())
    p = F.least(F.greatest(raw, F.lit(K.PROB_EPS)), F.lit(1.0 - K.PROB_EPS))
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(((p > 0.5).cast("double") == y).cast("double")).alias("accuracy"),
        F.avg(-(y * F.log(p) + (1.0 - y) * F.log(1.0 - p))).alias("log_loss"), F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(y).alias("home_win_rate"), F.avg(p).alias("mean_p_home"),
    )


def calibration_table(df: DataFrame, prob: str, label: str, bins: int = 10) -> DataFrame:
    """Quantile buckets of the prediction: size, mean prediction, actual rate, gap (4 digits)."""
    both = df.where(F.col(prob).isNotNull() & F.col(label).isNotNull())
    bucketed = scan.quantile_bucket(both, prob, bins)
    mean_p, actual = F.avg(F.col(prob).cast("double")), F.avg(F.col(label).cast("double"))
    return bucketed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bround(mean_p, 4).alias("p_home_mean"), F.bround(actual, 4).alias("actual_home_win"),
        F.bround(actual - mean_p, 4).alias("calibration_gap"),
    )


def stratify(df: DataFrame, feature: str, target: str, buckets: int = 5) -> DataFrame:
    """Quantile buckets of a feature with its range and the target's mean (3 digits)."""
    both = df.where(F.col(feature).isNotNull() & F.col(target).isNotNull())
    return scan.quantile_bucket(both, feature, buckets).groupBy("bucket").agg(
        F.bround(F.min(F.col(feature).cast("double")), 3).alias("bucket_min"),
        F.bround(F.max(F.col(feature).cast("double")), 3).alias("bucket_max"),
        F.count(F.lit(1)).alias("n"), F.bround(F.avg(F.col(target).cast("double")), 3).alias("mean_target"),
    )


def selective_accuracy(df: DataFrame, prob: str, label: str,
                       thresholds: Sequence[float] = (0.50, 0.52, 0.55, 0.58, 0.60)) -> DataFrame:
    """Bets, coverage and accuracy when only confident predictions count.

    Each row is compared with the short threshold list inside one aggregate per
    threshold, so rows are never multiplied.
    """
    p, y = F.col(prob), F.col(label).cast("int")
    rows = df.where(y.isNotNull())
    cells = []
    for t in thresholds:
        keep = F.abs(p - 0.5) >= (t - 0.5)
        home, away = keep & (p > 0.5), keep & (p <= 0.5)
        right = (p > 0.5).cast("int") == y
        cells.append(F.struct(
            F.lit(float(t)).alias("threshold"), F.count_if(keep).alias("bets"),
            F.try_divide(F.count_if(keep), F.count(F.lit(1))).alias("coverage"),
            F.avg(F.when(keep, right.cast("double"))).alias("accuracy"),
            F.avg(F.when(home, (y == 1).cast("double"))).alias("home_accuracy"),
            F.avg(F.when(away, (y == 0).cast("double"))).alias("away_accuracy"),
        ).alias(f"t{len(cells)}"))
    one = rows.agg(*cells)
    return one.select(F.inline(F.array(*[F.col(f"t{i}") for i in range(len(cells))]))).where(F.col("bets") > 0)


def baseline_metrics(df: DataFrame, label: str = "home_win", home_rate: str = "home_sp_SIERA", away_rate: str = "away_sp_SIERA") -> DataFrame:
    """Always-home accuracy, constant-probability scores and the lower-starter-rate pick."""
    y = F.col(label).cast("double")
    h, a = F.col(home_rate), F.col(away_rate)
    both = h.isNotNull() & a.isNotNull()
    rate = F.avg(y)
    p = F.least(F.greatest(rate, F.lit(K.PROB_EPS)), F.lit(1.0 - K.PROB_EPS))
    return df.where(y.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg((y == 1).cast("double")).alias("always_home_accuracy"),
        rate.alias("constant_p"), (-(rate * F.log(p) + (1.0 - rate) * F.log(1.0 - p))).alias("constant_log_loss"),
        (rate * (1.0 - rate)).alias("constant_brier"),
        F.avg(F.when(both, ((h < a).cast("double") == y).cast("double"))).alias("lower_rate_accuracy"),
        F.count_if(both).alias("lower_rate_n"),
    )


def feature_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of present values per column."""
    one = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("coverage")) for c in columns])
    return one.select(F.inline(pairs))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.agg(F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("corr"), F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, col: str, low: float, high: float, width: float = 1.0) -> DataFrame:
    """Counts per bin ``[edge, edge + width)``; the last bin also takes ``high`` itself."""
    bins = int((high - low) / width)
    inside = df.where((F.col(col) >= low) & (F.col(col) <= high))
    index = F.least(F.floor((F.col(col) - low) / width), F.lit(bins - 1))
    return inside.groupBy((F.lit(float(low)) + index * F.lit(float(width))).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
