"""Registry of the named queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..tables import Tables, bind_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``, with its oracle where SQL can state it."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, path: fn(Tables(spark, path))
        if sql is not None:
            ORACLES[name] = bind_sql(sql)
        return fn

    return register


def load_all() -> None:
    from . import (  # noqa: F401
        experiments, feedback, features, drift, models, monitoring, quality, relational, storage, streams, versioning,
    )
