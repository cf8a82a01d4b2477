"""Streaming forms give what a batch over all rows gives; replays change nothing."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import serving as S
from tessera.plans import domain as D
from tessera.streaming import ledger as L


@pytest.fixture
def deltas(spark, sf_dir):
    x = D.ledger(spark, sf_dir).where("event_id < 300")
    return x.withColumn("at", F.timestamp_seconds(F.lit(1704067200) + F.col("event_id")))


def drop_files(deltas, folder, cuts):
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        deltas.where((F.col("event_id") >= lo) & (F.col("event_id") < hi)).coalesce(1).write.mode("append").parquet(folder)


def test_latest_table(spark, deltas, tmp_path):
    folder, check, root = (f"file://{tmp_path}/{x}" for x in ("in", "check", "table"))
    table = L.LatestTable(spark, root)
    drop_files(deltas, folder, [0, 120])
    table.start(L.ledger_stream(spark, folder), check).awaitTermination()
    drop_files(deltas, folder, [120, 200, 300])
    drop_files(deltas, folder, [100, 150])  # sent again
    table.start(L.ledger_stream(spark, folder), check).awaitTermination()
    first = deltas.groupBy("idempotency_key").agg(F.min("event_id").alias("event_id"))
    want = S.latest_by_mark(deltas.join(first, ["event_id", "idempotency_key"]))
    assert {(r.article_id, r.event_id) for r in table.current().collect()} == {(r.article_id, r.event_id) for r in want.collect()}


def test_streaming_coalesce_equals_batch(spark, deltas, tmp_path):
    folder = f"file://{tmp_path}/in"
    drop_files(deltas, folder, [0, 100, 300])
    s = spark.readStream.schema(L.LEDGER_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    q = L.coalesced(s).writeStream.outputMode("complete").format("memory").queryName("dirty").trigger(availableNow=True).start()
    q.awaitTermination()
    want = S.coalesce_dirty(deltas, ["partition_id", "article_id"])
    assert spark.table("dirty").exceptAll(want).isEmpty() and want.exceptAll(spark.table("dirty")).isEmpty()


def test_tumbling_windows(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=7 * i), i) for i in range(60)]
    df = spark.createDataFrame(rows, "at timestamp, v long")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    s = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    q = L.tumbling(s, "1 hour", ["v"]).writeStream.outputMode("append").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.bucket_s: (r.v, r.n) for r in spark.table("tumbling").collect()}
    want = {r.b: (r.v, r.n) for r in df.groupBy((F.floor(F.unix_timestamp("at") / 3600) * 3600).alias("b")).agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n")).collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_generations(spark, tmp_path):
    g = S.Generations(spark, f"file://{tmp_path}/g")
    with pytest.raises(ValueError):
        g.read()
    df = spark.range(3).withColumnRenamed("id", "x")
    n = g.stage(df)
    assert g.states() == {1: "candidate"} and g.promote(n, None) and g.active() == 1 and not g.promote(2, None)
    m = g.stage(df.limit(1))
    assert not g.promote(m, 1, checks=df) and g.read().count() == 3 and g.states() == {1: "active", 2: "failed"}
    k = g.stage(df.limit(1))
    assert k == 3 and g.promote(k, 1) and g.read().count() == 1
    last = g.stage(df)
    assert g.promote(last, 3) and g.retain(1) == [1] and g.active() == 4 and g.states() == {2: "failed", 3: "retired", 4: "active"}


def test_one_of_two_writers_wins(spark, tmp_path):
    a, b = (S.Generations(spark, f"file://{tmp_path}/g") for _ in range(2))
    x, y = a.stage(spark.range(1)), b.stage(spark.range(2))
    assert x == y == 1 and a.promote(x, None) and not b.promote(y, None) and b.read().count() == 1


def test_batches_rewrite_their_buckets_only(spark, tmp_path):
    table = L.LatestTable(spark, f"file://{tmp_path}/t", buckets=8)
    rows = lambda ids, mark: spark.createDataFrame([(mark + i, i, "article_updated", False) for i in ids], "event_id long, article_id long, change_kind string, tombstone boolean")
    table.apply(rows(range(40), 0), 0)
    before = table.store.parts(1)
    table.apply(rows([3], 100), 1)
    after = table.store.parts(2)
    assert len(before) == len(after) == 8 and sum(before[k] != after[k] for k in before) == 1
    assert {r.article_id: r.event_id for r in table.current().collect()} == {i: 103 if i == 3 else i for i in range(40)}
