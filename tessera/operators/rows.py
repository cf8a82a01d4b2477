"""Row numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ranged(df: DataFrame, order: list[str], by: list[str], buckets: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their range ``_b`` and place ``_rn`` in it, and what comes ``_before`` each range and in ``_all``.

    Rows are cut at quantiles of the first order column; each range is numbered apart, and shifted by the
    counts of those before, which are ``buckets`` rows at most for each value of ``by``."""
    key = order[0]
    edges = sorted(set(df.approxQuantile(key, [i / buckets for i in range(1, buckets)], 0.25 / buckets)))
    bounds = F.array(*[F.lit(float(e)) for e in edges]) if edges else F.array(F.lit(0.0))
    cut = df.withColumn("_b", F.size(F.filter(bounds, lambda e: e < F.col(key).cast("double"))))
    sizes = cut.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # over counts of ranges, not over rows
    before = sizes.select(*by, "_b", (F.sum("_n").over(whole.orderBy("_b")) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("_all"))
    return cut.withColumn("_rn", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order))), before


def indexed(df: DataFrame, order: list[str], name: str = "row_index", buckets: int = 64) -> DataFrame:
    """0-based position by ``order`` (its first column numeric; all of them unique together)."""
    rows, before = _ranged(df, order, [], buckets)
    return rows.join(F.broadcast(before), "_b").withColumn(name, F.col("_before") + F.col("_rn") - 1).drop("_b", "_rn", "_before", "_all")


def ntile(df: DataFrame, n: int, order: list[str], name: str, by: list[str], buckets: int = 64) -> DataFrame:
    """NTILE(n) of each value of ``by`` (not null), by ``order``: the first chunks take one row more where it doesn't come out even."""
    rows, before = _ranged(df, order, by, buckets)
    at, size, more = F.col("_before") + F.col("_rn") - 1, F.floor(F.col("_all") / n), F.col("_all") % n
    long = more * (size + 1)
    chunk = F.when(at < long, F.floor(at / (size + 1))).otherwise(more + F.floor((at - long) / F.greatest(F.lit(1), size))) + 1
    return rows.join(before, [*by, "_b"]).withColumn(name, chunk.cast("long")).drop("_b", "_rn", "_before", "_all")
