"""Queries of window functions, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.compare import latest
from ..operators.rows import indexed, ntile
from ..registry import query
from . import domain as D


@query(D.with_(D.JUDGMENT) + "SELECT judgment_id, article_id FROM judgment QUALIFY row_number() OVER (PARTITION BY article_id, model_id, prompt_id ORDER BY created_s DESC, judgment_id DESC) = 1")
def window_latest(spark, d):
    """The latest row of each key."""
    return latest(D.judgment(spark, d), ["article_id", "model_id", "prompt_id"], [F.desc("created_s"), F.desc("judgment_id")]).select("judgment_id", "article_id")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS line FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_extendedprice DESC, l_linenumber) = 1")
def window_best_source(spark, d):
    """The best row by a priority, then other keys."""
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return latest(D.table(spark, d, "lineitem"), ["l_orderkey"], [rank.asc(), F.desc("l_extendedprice"), F.asc("l_linenumber")]).select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"))


@query("SELECT o_orderkey, sum(1) OVER (PARTITION BY o_custkey)::BIGINT AS customer_orders, min(o_orderpriority) OVER (PARTITION BY o_custkey) AS best FROM orders")
def window_partition_totals(spark, d):
    """Sums and minima over a partition."""
    w = Window.partitionBy("o_custkey")
    return D.table(spark, d, "orders").select("o_orderkey", F.count(F.lit(1)).over(w).alias("customer_orders"), F.min("o_orderpriority").over(w).alias("best"))


@query("SELECT o_orderstatus, o_orderkey, ntile(7) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey)::BIGINT AS chunk FROM orders")
def window_ntile(spark, d):
    """Balanced chunks of keys, numbered range by range and not a status in one task."""
    return ntile(D.table(spark, d, "orders").select("o_orderstatus", "o_orderkey"), 7, ["o_orderkey"], "chunk", by=["o_orderstatus"])


@query("""WITH c AS (SELECT o_orderstatus AS s, ntile(7) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS chunk, o_orderkey AS k FROM orders), r AS (SELECT s, chunk, min(k) AS lo, max(k) AS hi FROM c GROUP BY 1, 2)
SELECT s AS status, chunk::BIGINT AS chunk, coalesce(lag(hi) OVER w + 1, lo) AS first_key, CASE WHEN lead(lo) OVER w IS NULL THEN hi + 1 ELSE hi END AS last_key FROM r WINDOW w AS (PARTITION BY s ORDER BY chunk)""")
def window_close_gaps(spark, d):
    """LAG and LEAD close the gaps between neighbouring key ranges."""
    c = ntile(D.table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("k")), 7, ["k"], "chunk", by=["status"])
    r = c.groupBy("status", "chunk").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    w = Window.partitionBy("status").orderBy("chunk")
    return r.select("status", "chunk", F.coalesce(F.lag("hi").over(w) + 1, F.col("lo")).alias("first_key"), F.when(F.lead("lo").over(w).isNull(), F.col("hi") + 1).otherwise(F.col("hi")).alias("last_key"))


@query("SELECT DISTINCT c_mktsegment, first_value(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS winner FROM customer")
def window_first_value(spark, d):
    """The natural-key winner."""
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return D.table(spark, d, "customer").select("c_mktsegment", F.first_value("c_custkey").over(w).alias("winner")).distinct()


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 3")
def window_keep_newest(spark, d):
    """All but the newest n of a scope are evicted."""
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return D.table(spark, d, "events").withColumn("k", F.row_number().over(w)).where("k <= 3").select("event_type", "event_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents")
def window_row_index(spark, d):
    """A row index needs a key to go by in a distributed scan; ranges are numbered one by one."""
    return indexed(D.table(spark, d, "documents").select("doc_id"), ["doc_id"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def sort_top_k(spark, d):
    """The five largest."""
    return D.table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(5)


@query(D.with_(D.ARTICLE, D.JUDGMENT, D.PROMPT) + """, done AS (SELECT DISTINCT article_id, prompt_id FROM judgment WHERE trim(answer) <> ''), ever AS (SELECT DISTINCT article_id FROM done)
SELECT a.article_id, p.prompt_id, CASE WHEN e.article_id IS NULL THEN 0 ELSE 1 END AS priority FROM article a CROSS JOIN prompt p LEFT JOIN ever e ON e.article_id = a.article_id WHERE enabled AND NOT EXISTS (SELECT 1 FROM done d WHERE d.article_id = a.article_id AND d.prompt_id = p.prompt_id)""")
def queue_unassessed(spark, d):
    """Articles by enabled prompts without an answer; those never judged come first."""
    from ..operators.queue import unassessed

    return unassessed(D.article(spark, d), D.prompt(spark), D.judgment(spark, d))


@query(D.with_(D.ARTICLE, D.JUDGMENT, D.PROMPT, D.HUMAN) + """, done AS (SELECT DISTINCT article_id, prompt_id FROM judgment WHERE trim(answer) <> '')
SELECT a.article_id, p.prompt_id, h.article_id IS NOT NULL AS human_first FROM article a CROSS JOIN prompt p LEFT JOIN human h ON h.article_id = a.article_id AND h.prompt_id = p.prompt_id WHERE enabled AND NOT EXISTS (SELECT 1 FROM done d WHERE d.article_id = a.article_id AND d.prompt_id = p.prompt_id)""")
def queue_human_first(spark, d):
    """Pairs that a human has answered come first."""
    from ..operators.queue import human_first, unassessed

    return human_first(unassessed(D.article(spark, d), D.prompt(spark), D.judgment(spark, d)), D.human(spark, d)).select("article_id", "prompt_id", "human_first")


@query(D.with_(D.PROMPT) + "SELECT prompt_id, row_number() OVER (ORDER BY CASE prompt_type WHEN 'include' THEN 0 WHEN 'exclude' THEN 1 ELSE 2 END, prompt_order NULLS LAST, prompt_id) AS place FROM prompt")
def sort_detail_order(spark, d):
    """Priority, then order with nulls last, then id (over a configuration of a few rows)."""
    rank = F.when(F.col("prompt_type") == "include", 0).when(F.col("prompt_type") == "exclude", 1).otherwise(2)
    w = Window.partitionBy(F.lit(0)).orderBy(rank, F.asc_nulls_last("prompt_order"), "prompt_id")
    return D.prompt(spark).select("prompt_id", F.row_number().over(w).cast("long").alias("place"))
