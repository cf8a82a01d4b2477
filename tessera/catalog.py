"""Every query with its oracle SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import aggregates, compare, entities, filters, imports, joins, scalars, scans, serving, streams, timeline, windows  # noqa: F401  they register their queries
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["compare_pair_stats"](spark, sf_dir)
