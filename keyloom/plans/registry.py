"""Where the plan modules register their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, also: str | None = None):
    """Register a query and its SQL, under a second name too if it had one before."""
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        for n in filter(None, (name, also)):
            if n in QUERIES:
                raise ValueError(f"query {n!r} is registered twice")
            QUERIES[n] = fn
            if sql is not None:
                ORACLES[n] = sql
        return fn
    return add
