"""Names of queries, with their functions and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register ``f(spark, sf_dir)`` under its name, with the DuckDB text that should agree with it."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if oracle is not None:
            ORACLE[name or f.__name__] = oracle
        return f

    return add
