"""Registered queries: a Spark callable and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_MODULES = ("checks_history", "checks_rows", "checks_pool", "checks_market", "checks_model", "checks_games", "checks_stream")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    for module in _MODULES:
        import_module(f"tidemark.plans.{module}")


def rnd(col: Column | str, digits: int = 9) -> Column:
    """Round for comparison; adding zero turns -0.0 into 0.0."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def big(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("long")


def epoch(col: Column | str) -> Column:
    """Instant as whole seconds, comparable across engines."""
    return F.unix_timestamp(F.col(col) if isinstance(col, str) else col).cast("long")


def sql_rnd(expr: str, name: str, digits: int = 9) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"
