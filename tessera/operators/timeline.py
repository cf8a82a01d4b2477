"""Time buckets: tumbling, anchored with gaps filled, cadence slots, utilisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds of the interval names; a month is a calendar month (UTC).
INTERVALS = {"1min": 60, "5min": 300, "15min": 900, "1h": 3600, "24h": 86_400, "1w": 604_800}
MONTH = "1m"
MONDAY = 345_600  # of the first week of the epoch, a Thursday
#: Range and bucket seconds of the aligned presets.
PRESETS = {"5m": (300, 30), "15m": (900, 30), "1h": (3600, 60), "24h": (86_400, 900), "3d": (259_200, 3600)}


def bucket(seconds: Column, interval: str, anchor: int | None = None) -> Column:
    """Start (epoch seconds) of the bucket; weeks begin on Monday unless an anchor is given."""
    if interval == MONTH:
        return F.unix_timestamp(F.date_trunc("month", F.timestamp_seconds(seconds)))
    width = INTERVALS[interval]
    origin = F.lit(anchor if anchor is not None else MONDAY if interval == "1w" else 0)
    return (origin + F.floor((seconds - origin) / width) * width).cast("long")


def bucket_series(spark, interval: str, start: int, stop: int) -> DataFrame:
    """All bucket starts of [start, stop), anchored at ``start`` (months: from its month to that of ``stop``)."""
    if interval == MONTH:
        first, last = (F.date_trunc("month", F.timestamp_seconds(F.lit(x))) for x in (start, stop))
        return spark.range(1).select(F.explode(F.sequence(first, last, F.expr("INTERVAL 1 MONTH"))).alias("t")).select(F.unix_timestamp("t").alias("bucket_s"))
    return spark.range(1).select(F.explode(F.sequence(*[F.lit(x).cast("long") for x in (start, stop - 1, INTERVALS[interval])])).alias("bucket_s"))


def timeline(rows: DataFrame, interval: str, start: int, stop: int, measures: list[str], time_col: str = "created_s", complete: bool = True) -> DataFrame:
    """Sums of ``measures`` and a count by bucket in [start, stop); complete series have zeros in the gaps."""
    inside = rows.where((F.col(time_col) >= start) & (F.col(time_col) < stop))
    sums = inside.groupBy(bucket(F.col(time_col), interval, None if interval == MONTH else start).alias("bucket_s")).agg(*[F.sum(m).cast("long").alias(m) for m in measures], F.count(F.lit(1)).alias("n"))
    if not complete:
        return sums
    return bucket_series(rows.sparkSession, interval, start, stop).join(sums, "bucket_s", "left").fillna(0, [*measures, "n"])


def aligned_range(preset: str, now: int) -> tuple[int, int, int]:
    """(start, end, bucket seconds): the end is floored to the bucket."""
    length, width = PRESETS[preset]
    end = now // width * width
    return end - length, end, width


def aligned_columns(preset: str, now: Column) -> list[Column]:
    """:func:`aligned_range` of a column: start_s, end_s and width."""
    length, width = PRESETS[preset]
    end = (F.floor(now / width) * width).cast("long")
    return [(end - length).alias("start_s"), end.alias("end_s"), F.lit(width).cast("long").alias("width")]


def dedupe_slots(samples: DataFrame, keys: list[str], cadence: int, time_col: str = "sampled_s") -> DataFrame:
    """One sample (the earliest) per key and cadence slot."""
    w = Window.partitionBy(*keys, "slot").orderBy(time_col, "event_id")
    return samples.withColumn("slot", F.floor(F.col(time_col) / cadence) * cadence).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def utilisation(samples: DataFrame, width: int, order: dict[str, int]) -> DataFrame:
    """By bucket: fill percentages, the worst adherence state, the most frequent bottleneck (ties: the
    latest sample, then the name)."""
    b = (F.floor(F.col("sampled_s") / width) * width).cast("long").alias("bucket_s")
    fill = F.coalesce(F.col("fill_pct"), F.try_divide(F.col("leased") * 100.0, F.col("capacity")))
    x = samples.select(b, fill.alias("fill"), "state", "bottleneck", "sampled_s")
    rank = F.coalesce(*[F.when(F.col("state") == k, v) for k, v in order.items()])
    main = x.groupBy("bucket_s").agg(F.round(F.min("fill"), 4).alias("fill_min"), F.round(F.avg("fill"), 4).alias("fill_avg"), F.round(F.max("fill"), 4).alias("fill_max"), F.max_by("state", rank).alias("worst_state"))
    often = x.where("bottleneck is not null").groupBy("bucket_s", "bottleneck").agg(F.count(F.lit(1)).alias("n"), F.max("sampled_s").alias("last"))
    w = Window.partitionBy("bucket_s").orderBy(F.desc("n"), F.desc("last"), "bottleneck")
    return main.join(often.withColumn("k", F.row_number().over(w)).where("k = 1").select("bucket_s", "bottleneck"), "bucket_s", "left")
