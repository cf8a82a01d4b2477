"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, label) for every node of ``edges`` (src, dst); label is the least node of its component.

    Each round links a node's larger neighbours to the least node in reach (large star), then its
    smaller neighbours (small star). The edge count never grows; a round's result is written to the
    shared folder, so lost executors redo one round at most. The driver sees counts only. Self loops
    and repeated edges are allowed; an empty table gives an empty table. A star's centre may have
    any number of neighbours: they are only ever reduced with min() and joined by the centre, which
    adaptive execution splits.
    """
    cur = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct()
    cur = common.written(cur, "cc")
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("m"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low, "src")
        moved = small.where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        nxt = common.written(moved.union(low.select("src", F.col("m").alias("dst"))).distinct(), "cc")
        same = nxt.count() == cur.count() and nxt.exceptAll(cur).isEmpty()
        cur = nxt
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("src").alias("node"), F.col("dst").alias("label")).union(cur.select("dst", "dst").distinct())
