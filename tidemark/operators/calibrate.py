"""Probability calibration: Platt scaling by Newton steps and isotonic regression, both as Spark jobs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark import constants as K
from tidemark.functions.pricing import clip
from tidemark.operators import scan
from tidemark.session import stage

#: Newton steps at most; the loss of a fit that can be separated falls for ever.
_STEPS = 60


def _pairs(df: DataFrame, prob: str, label: str) -> DataFrame:
    """(p, y, weight) with equal pairs counted once."""
    both = df.select(F.col(prob).cast("double").alias("p"), F.col(label).cast("double").alias("y")).dropna()
    return both.groupBy("p", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))


def _newton_sums(pairs: DataFrame, slope: float, intercept: float) -> list[float]:
    """Loss, gradient and Hessian of the logistic loss, one row."""
    z = F.lit(slope) * F.col("p") + F.lit(intercept)
    q = 1.0 / (1.0 + F.exp(-z))
    loss = F.greatest(z, F.lit(0.0)) - z * F.col("y") + F.log1p(F.exp(-F.abs(z)))
    miss, spread = F.col("w") * (q - F.col("y")), F.col("w") * q * (1.0 - q)
    p = F.col("p")
    row = pairs.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in (F.col("w") * loss, miss * p, miss, spread * p * p, spread * p, spread)]).first()
    return [float(v) for v in row]


def fit_platt(df: DataFrame, prob: str, label: str) -> DataFrame:
    """One-row table (slope, intercept, A, B, train_n, train_p_mean, train_y_rate).

    Newton's method from zero on counted pairs: every step is one aggregate of six sums, and a step that would raise the loss is halved.
    A missing probability or label takes no part; without rows slope and intercept are zero.
    """
    pairs = stage(_pairs(df, prob, label), "pairs")
    slope = intercept = 0.0
    loss, ga, gb, haa, hab, hbb = _newton_sums(pairs, slope, intercept)
    for _ in range(_STEPS):
        det = haa * hbb - hab * hab
        if det <= 1e-12 * max(haa * hbb, 1e-300):
            if hbb <= 0:
                break
            step_a, step_b = 0.0, gb / hbb  # one probability only: its rate is all there is to learn
        else:
            step_a, step_b = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        for _ in range(30):
            tried = _newton_sums(pairs, slope - step_a, intercept - step_b)
            if tried[0] <= loss + 1e-12 * abs(loss):
                break
            step_a, step_b = step_a / 2, step_b / 2
        slope, intercept = slope - step_a, intercept - step_b
        loss, ga, gb, haa, hab, hbb = tried
        if math.hypot(step_a, step_b) <= 1e-12 * (1.0 + math.hypot(slope, intercept)):
            break
    return pairs.agg(
        F.lit(slope).alias("slope"), F.lit(intercept).alias("intercept"), F.lit(-slope).alias("A"), F.lit(-intercept).alias("B"),
        F.coalesce(F.sum("w"), F.lit(0.0)).cast("long").alias("train_n"), F.try_divide(F.sum(F.col("p") * F.col("w")), F.sum("w")).alias("train_p_mean"),
        F.try_divide(F.sum(F.col("y") * F.col("w")), F.sum("w")).alias("train_y_rate"),
    )


def _clipped(p: Column) -> Column:
    return clip(p.cast("double"), K.PROB_EPS, 1.0 - K.PROB_EPS)


def apply_platt(df: DataFrame, fit: DataFrame, prob: str, out: str = "p_calibrated") -> DataFrame:
    """Calibrated probability; a missing input stays missing."""
    row = fit.select("slope", "intercept").first()
    z = F.lit(row["slope"]) * _clipped(F.col(prob)) + F.lit(row["intercept"])
    return df.withColumn(out, _clipped(1.0 / (1.0 + F.exp(-z))))


_BLOCK = "part long, place long, size long, low double, high double, w double, y double"


def pooled(low: np.ndarray, high: np.ndarray, w: np.ndarray, y: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Pool-adjacent-violators: neighbouring blocks (range, weight, weighted sum) merge until their means rise."""
    out: list[tuple[float, float, float, float]] = []
    for block in zip(low.tolist(), high.tolist(), w.tolist(), y.tolist()):
        while out and out[-1][3] * block[2] >= block[3] * out[-1][2]:  # mean before >= mean here
            a = out.pop()
            block = (a[0], block[1], a[2] + block[2], a[3] + block[3])
        out.append(block)
    return out


def _pool(parts: DataFrame) -> DataFrame:
    """Pool inside every part; a part is a range or a chunk of blocks."""
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("low", kind="stable")
        found = pooled(*(batch[c].to_numpy(dtype=float) for c in ("low", "high", "w", "y")))
        columns = np.array(found, dtype=float).T
        return pd.DataFrame({"part": int(batch["part"].iloc[0]), "place": np.arange(len(found)), "size": len(found),
                             "low": columns[0], "high": columns[1], "w": columns[2], "y": columns[3]})

    return stage(parts.groupBy("part").applyInPandas(run, _BLOCK), "isotonic")


def fit_isotonic(df: DataFrame, prob: str, label: str, ranges: int | None = None, chunk: int = 100_000) -> DataFrame:
    """Blocks (``low``, ``high``, ``value``, ``next_low``, ``next_value``) of the monotone fit, equal probabilities pooled first.

    The rows are cut into ranges of the probability and pooled inside each. While the last mean of a part is not below the first one of
    the next, blocks are cut anew, ``chunk`` to a part, the cuts moved by half a part each time, and pooled again. Merging neighbours
    in any order gives the same blocks, and a violated border lies inside a part of the next round, so every round merges some.
    What the driver reads is one number per round.
    """
    points = _pairs(df, prob, label).groupBy("p").agg(F.sum("w").alias("w"), F.sum(F.col("y") * F.col("w")).alias("y"))
    ranged = scan.with_ranges(points, ["p"], ranges)
    blocks = _pool(ranged.select(F.col(scan.BUCKET).cast("long").alias("part"), F.col("p").alias("low"), F.col("p").alias("high"), "w", "y"))
    offset = chunk // 2
    while True:
        # One row for each part: as many as ranges, whatever the data.
        edges = blocks.groupBy("part").agg(F.min_by(F.struct("low", "w", "y"), "low").alias("head"), F.max_by(F.struct("w", "y"), "low").alias("tail"), F.count(F.lit(1)).alias("n"))
        order = W.orderBy("part")
        edges = edges.withColumns({"after": F.lead("head").over(order), "earlier": F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
        violated = F.col("tail.y") * F.col("after.w") >= F.col("after.y") * F.col("tail.w")  # the comparison of ``pooled``
        if not edges.where(violated).count():
            break
        place = F.col("earlier") + F.col("place") + offset
        blocks = _pool(blocks.join(edges.select("part", "earlier"), "part").select(F.floor(place / chunk).alias("part"), "low", "high", "w", "y"))
        offset = chunk // 2 - offset
    inside, value = W.partitionBy("part").orderBy("low"), F.col("y") / F.col("w")
    return blocks.join(edges.select("part", "after"), "part").select(
        "low", "high", value.alias("value"), F.coalesce(F.lead("low").over(inside), F.col("after.low")).alias("next_low"),
        F.coalesce(F.lead(value).over(inside), F.col("after.y") / F.col("after.w")).alias("next_value"))


def apply_isotonic(df: DataFrame, fit: DataFrame, prob: str, out: str = "p_calibrated") -> DataFrame:
    """Calibrated probability: a block's value inside it, a straight line between blocks, the outermost values beyond them.

    Different probabilities meet the blocks in one ranged as-of scan: blocks rise with their lower ends, so the block that holds is the
    largest one so far. The answers return by an equi-join. A missing input stays missing.
    """
    asked = df.select(F.col(prob).cast("double").alias("_p")).where(F.col("_p").isNotNull()).distinct()
    block = F.struct("low", "high", "value", "next_low", "next_value")
    both = fit.select(F.col("low").alias("_p"), F.lit(0).alias("_kind"), block.alias("_block")).unionByName(
        asked.select("_p", F.lit(1).alias("_kind")), allowMissingColumns=True)
    order = ["_p", "_kind"]
    met = scan.running(scan.with_ranges(both, order), {"_at": ("max", "_block")}, order).where(F.col("_kind") == 1)
    p, at = F.col("_p"), F.col("_at")
    share = (p - at["high"]) / (at["next_low"] - at["high"])
    between = F.when(at["next_low"].isNotNull(), at["value"] + share * (at["next_value"] - at["value"])).otherwise(at["value"])
    lowest = fit.agg(F.min("value")).scalar()
    answer = F.when(at.isNull(), lowest).when(p <= at["high"], at["value"]).otherwise(between)
    answers = met.select("_p", _clipped(answer).alias(out))
    return df.withColumn("_p", F.col(prob).cast("double")).join(answers, "_p", "left").drop("_p")
