"""Where the named queries are gathered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable:
    """Registers a function of Inputs as the query of this key, and the SQL that gives the same rows."""

    def add(f: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        assert key not in QUERIES, key
        QUERIES[key] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add
