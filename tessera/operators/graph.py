"""Connected components of records that share identifiers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, where one is named."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        import tempfile

        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{tempfile.gettempdir()}/tessera-{uuid.uuid4().hex}")
    return df.checkpoint()


def components(members: DataFrame, node: str = "node", key: str = "key", max_rounds: int = 40) -> DataFrame:
    """(node, component): the least node reachable over shared keys, for rows of (node, key).

    Each round takes the least label of every key, then of every node, and jumps along labels, so that
    long chains need few rounds. A key shared by very many nodes is reduced by map-side minima."""
    m = _cut(members.select(F.col(node).alias("node"), F.col(key).alias("key")).where("node is not null and key is not null").distinct())
    label = m.select("node").distinct().withColumn("label", F.col("node"))
    for _ in range(max_rounds):
        by_key = m.join(label, "node").groupBy("key").agg(F.min("label").alias("label"))
        offered = m.join(by_key, "key").groupBy("node").agg(F.min("label").alias("offer"))
        x = label.join(offered, "node").select("node", "label", F.least("label", "offer").alias("to"))
        jump = x.select(F.col("node").alias("via"), F.col("to").alias("further"))
        nxt = _cut(x.join(jump, x["to"] == jump["via"]).select("node", F.col("label").alias("was"), F.least("to", "further").alias("label")))
        done = nxt.where("label <> was").isEmpty()
        label = nxt.select("node", "label")
        if done:
            return label.withColumnRenamed("label", "component")
    raise RuntimeError("components did not settle")
