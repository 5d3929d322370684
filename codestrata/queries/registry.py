"""Named queries over the driver's tables, each with the SQL another engine can answer it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import oracle_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(bound)``; ``sql`` may use every relation of :mod:`bindings`."""

    def register(fn):
        from .bindings import Bound

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Bound(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle_with(sql)
        return fn

    return register
