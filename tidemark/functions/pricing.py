"""Market prices: conversions, margin removal, expected value and stake sizing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark import constants as K


def american_to_decimal(price: Column) -> Column:
    return F.when(price >= 0, 1.0 + price / 100.0).when(price < 0, 1.0 + F.try_divide(F.lit(100.0), F.abs(price)))


def decimal_to_implied(odds: Column) -> Column:
    return F.when(odds > 0, 1.0 / odds)


def american_to_implied(price: Column) -> Column:
    return decimal_to_implied(american_to_decimal(price))


def american_to_implied_legacy(price: Column) -> Column:
    """Older conversion: a missing price counts as 0 and only ``> 0`` is an underdog."""
    p = F.coalesce(price.cast("double"), F.lit(0.0))
    return F.when(p > 0, 100.0 / (p + 100.0)).otherwise(-p / (-p + 100.0))


def fair_proportional(p: Column, q: Column) -> tuple[Column, Column]:
    """Scale both implied probabilities so they sum to one."""
    total = p + q
    return F.when(total > 0, p / total), F.when(total > 0, q / total)


def power_exponent(p: Column, q: Column, steps: int = 64) -> Column:
    """Exponent ``k`` in [0.5, 2] with ``p**k + q**k = 1``, by bisection inside the JVM."""
    def halve(state, _step):
        mid = (state["lo"] + state["hi"]) * 0.5
        above = F.pow(p, mid) + F.pow(q, mid) > 1.0
        return F.struct(
            F.when(above, mid).otherwise(state["lo"]).alias("lo"),
            F.when(above, state["hi"]).otherwise(mid).alias("hi"),
        )

    start = F.struct(F.lit(0.5).alias("lo"), F.lit(2.0).alias("hi"))
    solved = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["lo"] + s["hi"]) * 0.5)
    return F.when((p > 0) & (q > 0), solved)


def fair_power(p: Column, q: Column) -> tuple[Column, Column]:
    k = power_exponent(p, q)
    return F.pow(p, k), F.pow(q, k)


def remove_vig(p: Column, q: Column, method: str = "proportional") -> tuple[Column, Column]:
    if method == "proportional":
        return fair_proportional(p, q)
    if method == "power":
        return fair_power(p, q)
    raise ValueError(f"unknown margin-removal method: {method!r}")


def vig_pct(p: Column, q: Column) -> Column:
    return p + q - 1.0


def expected_value(p: Column, decimal_odds: Column) -> Column:
    """Expected profit per unit staked at decimal odds."""
    return p * decimal_odds - 1.0


def expected_value_american(p: Column, price: Column, stake: float | Column = 1.0) -> Column:
    """Expected profit of ``stake`` at an American price (missing inputs count as 0)."""
    p = F.coalesce(p.cast("double"), F.lit(0.0))
    a = F.coalesce(price.cast("double"), F.lit(0.0))
    profit = F.when(a > 0, a / 100.0).otherwise(F.try_divide(F.lit(100.0), -a))
    return stake * (p * profit - (1.0 - p))


def kelly_fraction(p: Column, decimal_odds: Column, fraction: float = 1.0, cap: float | None = 0.10) -> Column:
    b = decimal_odds - 1.0
    full = F.when(b > 0, (b * p - (1.0 - p)) / b).when(b.isNotNull(), F.lit(0.0))
    sized = F.when(full.isNotNull(), F.greatest(full, F.lit(0.0))) * float(fraction)
    return sized if cap is None else F.when(sized.isNotNull(), F.least(sized, F.lit(float(cap))))


def kelly_reference_fallback(cap: float | None = None, multiplier: float | None = None) -> float:
    """Denominator used when a slate left no mean stake behind."""
    cap = K.KELLY_CAP if cap is None else cap
    cap = cap if cap > 0 else 0.01
    multiplier = K.KELLY_MULTIPLIER if multiplier is None else multiplier
    return float(cap) * float(multiplier) * K.KELLY_REF_MULTIPLE


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def kelly_to_units(
    kelly: Column, ref: Column | None = None, cap: float | None = K.KELLY_CAP,
    anchor: float = 0.5, low: float = K.UNITS_MIN, high: float = K.UNITS_MAX,
) -> Column:
    """Units at risk: Kelly over the slate's mean Kelly, clipped."""
    if ref is not None:
        usable = F.when((ref > 0) & ~F.isnan(ref), ref).otherwise(F.lit(kelly_reference_fallback(cap)))
        return clip(kelly / usable, low, high)
    if cap is not None and cap > 0:
        return clip(kelly / F.lit(float(cap) * anchor), low, high)
    return F.lit(min(max(1.0, low), high))


def outcome_of(side: Column, home_score: Column, away_score: Column) -> Column:
    """``won`` / ``lost`` / ``push``; NULL until both scores are known."""
    return (
        F.when(home_score == away_score, "push")
        .when(((side == "home") & (home_score > away_score)) | ((side == "away") & (away_score > home_score)), "won")
        .when(home_score.isNotNull() & away_score.isNotNull(), "lost")
    )


def settle_profit(outcome: Column, decimal_odds: Column, risk: Column) -> Column:
    return (
        F.when(outcome == "push", F.lit(0.0))
        .when(outcome == "won", risk * (decimal_odds - 1.0))
        .when(outcome == "lost", -risk)
    )
