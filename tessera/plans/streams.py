"""Queries that run a stream over all rows and return what it left behind."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..registry import query
from ..streaming import ledger as L
from . import domain as D


def folder(spark) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``, else (local sessions) a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/tessera-streams"
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _drop(spark, d, folder: str, files: int = 4):
    """The ledger as an arriving folder of files in event order; its schema."""
    x = D.ledger(spark, d).withColumn("at", F.timestamp_seconds(F.lit(D.EPOCH) + F.col("event_id")))
    x.repartitionByRange(files, "event_id").write.parquet(folder)
    return x


@query(D.with_(D.LEDGER) + ", first AS (SELECT idempotency_key, min(event_id) AS event_id FROM ledger GROUP BY 1)\nSELECT article_id, event_id, change_kind FROM (SELECT l.* FROM ledger l JOIN first USING (idempotency_key, event_id) QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY event_id DESC) = 1) WHERE NOT tombstone")
def stream_latest(spark, d):
    """Each key once, the latest change of an article wins, generations are swapped per batch."""
    home = folder(spark)
    _drop(spark, d, f"{home}/in")
    table = L.LatestTable(spark, f"{home}/table")
    table.start(L.ledger_stream(spark, f"{home}/in", 2), f"{home}/check").awaitTermination()
    return table.current().select("article_id", "event_id", "change_kind")


@query(D.with_(D.LEDGER) + "SELECT partition_id, article_id, min(event_id) AS first_mark, max(event_id) AS latest_mark, count(*) AS changes FROM ledger GROUP BY 1, 2")
def stream_coalesce(spark, d):
    """Pending work per scope as a streaming aggregation, its last state kept by foreachBatch."""
    home = folder(spark)
    _drop(spark, d, f"{home}/in")
    s = spark.readStream.schema(L.LEDGER_SCHEMA).parquet(f"{home}/in")

    def keep(batch, n):
        batch.write.mode("overwrite").parquet(f"{home}/out-{n}")

    q = L.coalesced(s).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{home}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{home}/out-{q.lastProgress['batchId']}") if q.lastProgress else spark.read.parquet(f"{home}/out-0")


@query("WITH h AS (SELECT date_trunc('hour', ts) AS h, user_id FROM events) SELECT epoch(h)::BIGINT AS bucket_s, sum(user_id)::BIGINT AS user_id, count(*) AS n FROM h WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY h")
def stream_tumbling(spark, d):
    """Windows in append mode: those that the watermark has passed."""
    home = folder(spark)
    e = D.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at"), "user_id")
    e.repartitionByRange(4, "at").write.parquet(f"{home}/in")
    s = spark.readStream.schema(e.schema).parquet(f"{home}/in")
    q = L.tumbling(s, "1 hour", ["user_id"]).writeStream.outputMode("append").format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("bucket_s long, user_id long, n long").parquet(f"{home}/out")


@query("SELECT user_id % 5 AS job_id, floor(epoch(ts) / 600)::BIGINT * 600 AS slot_s, 1::BIGINT AS kept FROM events GROUP BY 1, 2")
def stream_cadence_slots(spark, d):
    """One sample per job and slot, by streaming deduplication."""
    home = folder(spark)
    e = D.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at"), (F.col("user_id") % 5).alias("job_id"))
    e.repartitionByRange(4, "at").write.parquet(f"{home}/in")
    s = spark.readStream.schema(e.schema).parquet(f"{home}/in")
    kept = L.slots(s, ["job_id"], "10 minutes").select("job_id", F.unix_timestamp("slot").alias("slot_s"))
    kept.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/check").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("job_id long, slot_s long").parquet(f"{home}/out")
    return out.groupBy("job_id", "slot_s").agg(F.count(F.lit(1)).alias("kept"))
