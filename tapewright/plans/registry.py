"""Registered queries: a function over (spark, folder of tables) by name, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle import sql

_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(oracle: str | None = None):
    def put(f):
        _FOUND[f.__name__] = (f, sql(oracle) if oracle else None)
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for k, (_, q) in _FOUND.items() if q}
