"""Aggregations: ordered lists and checksums, bins, percentiles, contribution diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rows import indexed

MOST_BINS = 10


def ordered_distinct(col) -> Column:
    """LIST(DISTINCT x ORDER BY x)."""
    return F.array_sort(F.collect_set(col))


def ordered_list(value: str, order: str) -> Column:
    """ARRAY_AGG(value ORDER BY order, value)."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value])


def checksum(col: str) -> Column:
    """SHA-256 of the sorted values joined by |; that of the empty text where there are none."""
    return F.sha2(F.coalesce(F.expr(f"listagg({col}, '|') WITHIN GROUP (ORDER BY {col})"), F.lit("")), 256)


def equal_width_bins(df: DataFrame, col: str, most: int = MOST_BINS) -> DataFrame:
    """(low, high, n) of integer bins: one value, one bin an integer, or at most ``most`` of one width."""
    v = df.where(F.col(col).isNotNull()).select(F.col(col).cast("long").alias("v"))
    ends = F.broadcast(v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))  # one row
    span = F.col("hi") - F.col("lo")
    width = F.when(span < most, F.lit(1)).otherwise(F.ceil((span + 1) / most)).cast("long")
    low = F.col("lo") + F.floor((F.col("v") - F.col("lo")) / F.col("w")) * F.col("w")
    x = v.crossJoin(ends).withColumn("w", width).select(low.cast("long").alias("low"), "hi", "w")
    return x.groupBy("low", "hi", "w").agg(F.count(F.lit(1)).alias("n")).select("low", F.least(F.col("low") + F.col("w") - 1, F.col("hi")).alias("high"), "n")


def quantile_bins(df: DataFrame, col: str, most: int = MOST_BINS) -> DataFrame:
    """(bin, low, high, n) of distinct values: beyond three, values outside the quartiles by 1.5 IQR
    are left out; up to ``most`` values stand alone, more are dealt evenly.

    Distinct values are numbered range by range (see :mod:`.rows`), quartiles are the values at their places, and
    what outliers there are below is a count: nothing but ranges' counts meets in one task."""
    v = df.where(F.col(col).isNotNull()).select(F.col(col).alias("v")).distinct()
    ranked = indexed(v, ["v"], "rn")
    total = F.broadcast(v.agg(F.count(F.lit(1)).alias("total")))  # one row, as the next two
    at = lambda q: F.max(F.when(F.col("rn") == F.floor(F.col("total") * q), F.col("v")))
    fence = F.broadcast(ranked.crossJoin(total).groupBy("total").agg(at(0.25).alias("q1"), at(0.75).alias("q3")))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("total") < 4) | F.col("v").between(F.col("q1") - reach, F.col("q3") + reach)
    kept = ranked.crossJoin(fence).where(inside).select("v", "rn")
    first = F.broadcast(kept.agg(F.min("rn").alias("first"), F.count(F.lit(1)).alias("n_kept")))
    size = F.when(F.col("n_kept") <= most, 1).otherwise(F.ceil(F.col("n_kept") / most))
    return kept.crossJoin(first).groupBy(F.floor((F.col("rn") - F.col("first")) / size).cast("long").alias("bin")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))


def nearest_rank(df: DataFrame, col: str, share: float, ties: list[str]) -> DataFrame:
    """The row at rank ceil(share x n) of ``col``."""
    w = Window.partitionBy(F.lit(0)).orderBy(col, *ties)  # over time buckets, not source rows
    x = df.withColumn("_rn", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    return x.where(F.col("_rn") == F.greatest(F.lit(1), F.ceil(F.col("_n") * share))).drop("_rn", "_n")


def contribution_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Delta per key between two sets of contributions; keys that don't change are left out."""
    both = new.select(*keys, F.col(value).alias("_v")).unionByName(old.select(*keys, (-F.col(value)).alias("_v")))
    return both.groupBy(*keys).agg(F.sum("_v").alias("delta")).where("delta <> 0")
