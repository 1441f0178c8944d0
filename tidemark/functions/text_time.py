"""String, date and array helpers used around the tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EASTERN = "America/New_York"


def title_name(first: Column, last: Column) -> Column:
    return F.concat_ws(" ", F.initcap(first), F.initcap(last))


def surname(name: Column) -> Column:
    """Last word, capitalised; ``TBD`` when there is no name."""
    trimmed = F.trim(F.coalesce(name, F.lit("")))
    return F.when(trimmed == "", "TBD").otherwise(F.initcap(F.element_at(F.split(trimmed, r"\s+"), -1)))


def percent(text: Column) -> Column:
    """``"4%"`` -> 0.04; unparsable text -> NULL."""
    return F.rtrim(text, F.lit("%")).try_cast("double") / 100.0


def eastern_date(instant: Column) -> Column:
    """Calendar date in New York of a UTC instant."""
    return F.to_date(F.from_utc_timestamp(instant, EASTERN))


def eastern_label(instant: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(instant, EASTERN), "MMM dd · HH:mm")


def first_of(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def has_any(array: Column) -> Column:
    """Whether a list has an element; a missing one has none."""
    return F.coalesce(F.size(array) > 0, F.lit(False))


def holds(array: Column, value: Column) -> Column:
    return F.coalesce(F.array_contains(array, value), F.lit(False))


def first_n(array: Column, n: int) -> Column:
    return F.slice(array, 1, n)


def attempts_from_rates(oaa: Column, rate_text: Column) -> Column:
    """Attempts implied by a rounded success-rate difference; NULL when either is zero."""
    oaa, rate = oaa.try_cast("double"), percent(rate_text)
    ratio = F.when((F.abs(oaa) > 0) & (F.abs(rate) > 0), F.abs(oaa) / F.abs(rate))
    return F.bround(ratio, 0).cast("long")
