"""Structured Streaming forms of the incremental operators.

The file source stands for the append-only ledger; a query's checkpoint holds what leases, claims and
acknowledgements hold elsewhere. Every sink is idempotent by batch, so a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import serving as S

LEDGER_SCHEMA = "event_id long, partition_id long, article_id long, change_kind string, idempotency_key string, tombstone boolean, at timestamp"


def ledger_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Deltas of Parquet files as they arrive, each idempotency key once.

    State for a key is dropped an hour of event time after it was seen; replays within that are caught."""
    s = spark.readStream.schema(LEDGER_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return s.withWatermark("at", "1 hour").dropDuplicatesWithinWatermark(["idempotency_key"])


def coalesced(deltas: DataFrame) -> DataFrame:
    """Dirty work per scope as a streaming aggregation (update mode)."""
    return S.coalesce_dirty(deltas, ["partition_id", "article_id"])


def slots(samples: DataFrame, keys: list[str], cadence: str, time_col: str = "at") -> DataFrame:
    """One sample per key and cadence slot, by state that the watermark bounds."""
    w = samples.withColumn("slot", F.window(time_col, cadence)["start"])
    return w.withWatermark(time_col, "1 hour").dropDuplicates([*keys, "slot"])


def tumbling(rows: DataFrame, width: str, measures: list[str], time_col: str = "at", late: str = "1 hour", start: str | None = None) -> DataFrame:
    """Sums per tumbling window, final once the watermark has passed (append mode)."""
    win = F.window(time_col, width, width, start) if start else F.window(time_col, width)
    return rows.withWatermark(time_col, late).groupBy(win.alias("w")).agg(*[F.sum(m).cast("long").alias(m) for m in measures], F.count(F.lit(1)).alias("n")).select(F.unix_timestamp("w.start").alias("bucket_s"), *measures, "n")


class LatestTable:
    """A generation-swapped table of each article's latest delta, fed batch by batch. It is cut into buckets by
    article; a batch rewrites the buckets that it touches and leaves the others where they are."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.store, self.buckets = spark, S.Generations(spark, root), buckets

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Merge by highest mark; tombstones stay as rows so that a late older delta can't revive one."""
        active = self.store.active()
        rows = batch.select("event_id", "article_id", "change_kind", "tombstone", F.pmod(F.xxhash64("article_id"), F.lit(self.buckets)).cast("int").alias("bucket"))
        touched = [str(r.bucket) for r in rows.select("bucket").distinct().collect()]  # ``buckets`` numbers at most
        if not touched:
            return
        if any(part in touched for part in self.store.parts(active)):
            stored = self.store.read(touched)
            rows = rows.unionByName(stored.withColumn("bucket", F.pmod(F.xxhash64("article_id"), F.lit(self.buckets)).cast("int")).select(*rows.columns))
        merged = rows.groupBy("bucket", "article_id").agg(F.max_by(F.struct("event_id", "change_kind", "tombstone"), "event_id").alias("r")).select("r.event_id", "article_id", "r.change_kind", "r.tombstone", "bucket")
        n = self.store.stage(merged, by="bucket")
        if not self.store.promote(n, active):
            raise RuntimeError("another writer has promoted a generation; the batch will be replayed")
        self.store.retain(1)

    def start(self, deltas: DataFrame, checkpoint: str):
        return deltas.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def current(self) -> DataFrame:
        return self.store.read().where("not tombstone")
