"""Rate statistics and run-expectation formulas as Columns (missing = NULL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import constants as K


def _num(col) -> Column:
    return F.coalesce(col.cast("double") if isinstance(col, Column) else F.col(col).cast("double"), F.lit(0.0))


def safe_div(num: Column, den: Column) -> Column:
    """``num / den`` where ``den > 0``, else NULL."""
    return F.when(den > 0, num.cast("double") / den)


def siera(so, bb, gb, fb, pu, pa) -> Column:
    """Skill-interactive run average from raw counts; NULL without a plate appearance."""
    so, bb, gb, fb, pu, pa = (_num(c) for c in (so, bb, gb, fb, pu, pa))
    k = F.try_divide(so, pa)
    w = F.try_divide(bb, pa)
    g = F.try_divide(gb - fb - pu, pa)
    w_sq = F.when(w < 0.105, -(w * w)).otherwise(w * w)
    return (
        F.lit(6.145) - 16.986 * k + 11.434 * w - 1.858 * g
        + 7.653 * (k * k) + 6.664 * w_sq + 10.130 * (k * g) - 5.195 * (w * g)
    )


def fip(k, bb, hbp, hr, ip, constant: float | Column = K.FIP_DEFAULT) -> Column:
    k, bb, hbp, hr, ip = (_num(c) for c in (k, bb, hbp, hr, ip))
    return F.try_divide(13.0 * hr + 3.0 * (bb + hbp) - 2.0 * k, ip) + constant


def xfip(k, bb, hbp, fb, ip, hr_per_fly: float = K.HR_PER_FLY, constant: float | Column = K.FIP_DEFAULT) -> Column:
    return fip(k, bb, hbp, _num(fb) * hr_per_fly, ip, constant)


def fip_constant(season: Column) -> Column:
    """Season constant, falling back to the default for unlisted seasons."""
    table = F.create_map(*[F.lit(v) for pair in K.FIP_CONSTANTS.items() for v in pair])
    return F.coalesce(F.try_element_at(table, season.cast("int")), F.lit(K.FIP_DEFAULT))


def pythag(scored: Column, allowed: Column, exponent: float = K.PYTHAG_EXPONENT) -> Column:
    """Win expectation; NULL inputs stay NULL."""
    def raised(x):
        return F.pow(F.when(x.isNotNull(), F.greatest(x, F.lit(K.PROB_EPS))), F.lit(exponent))

    s, a = raised(scored), raised(allowed)
    return s / (s + a)


def pythag_zero_filled(scored: Column, allowed: Column, exponent: float = K.PYTHAG_EXPONENT) -> Column:
    """Win expectation that reads a missing run total as zero runs."""
    return pythag(F.coalesce(scored, F.lit(0.0)), F.coalesce(allowed, F.lit(0.0)), exponent)


def with_rates(df: DataFrame, suffix: str = "") -> DataFrame:
    """Add the twelve rate columns derived from ``<counter>_cum<suffix>``."""
    def c(name: str) -> Column:
        return F.col(f"{name}_cum{suffix}")

    pa, bbe, den = c("PA"), c("BBE"), c("WOBA_DEN")
    bip = c("GB") + c("FB") + c("PU") + c("LD")
    rates = {
        "BIP_cum": bip,
        "K_pct": safe_div(c("SO"), pa),
        "BB_pct": safe_div(c("BB"), pa),
        "HR_pct": safe_div(c("HR"), pa),
        "GB_pct": safe_div(c("GB"), bip),
        "FB_pct": safe_div(c("FB"), bip),
        "LD_pct": safe_div(c("LD"), bip),
        "PU_pct": safe_div(c("PU"), bip),
        "Barrel_pct": safe_div(c("BARREL"), bbe),
        "xwOBA": safe_div(c("XWOBA_NUM"), den),
        "wOBA": safe_div(c("WOBA_NUM"), den),
        "SIERA": siera(c("SO"), c("BB"), c("GB"), c("FB"), c("PU"), pa),
    }
    return df.withColumns({f"{name}{suffix}": col for name, col in rates.items()})


def with_count_rates(df: DataFrame) -> DataFrame:
    """Rates over a plain counts frame (``PA``, ``SO``, …, ``BIP``)."""
    per = {"K_pct": ("SO", "PA"), "BB_pct": ("BB", "PA"), "HR_pct": ("HR", "PA"),
           "GB_pct": ("GB", "BIP"), "FB_pct": ("FB", "BIP"), "LD_pct": ("LD", "BIP"), "PU_pct": ("PU", "BIP")}
    return df.withColumns({name: F.try_divide(F.col(n), F.col(d)) for name, (n, d) in per.items()})
