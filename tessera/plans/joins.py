"""Queries of joins (J01-J18), over the relational tables and the review domain."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..registry import query
from . import domain as D


@query("SELECT l_returnflag, n_name, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2")
def join_inner(spark, d):
    """Inner equi-joins, filter on one side."""
    t = lambda n: D.table(spark, d, n)
    x = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.where("o_orderpriority = '1-URGENT'").groupBy("l_returnflag", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(D.with_(D.ARTICLE, D.HUMAN) + "SELECT a.article_id, h.answer FROM article a LEFT JOIN human h ON h.article_id = a.article_id AND h.prompt_id = 1")
def join_left(spark, d):
    """Hydration keeps the base row."""
    h = D.human(spark, d).where("prompt_id = 1").select("article_id", "answer")
    return D.article(spark, d).select("article_id").join(h, "article_id", "left")


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) GROUP BY 1")
def join_semi(spark, d):
    """EXISTS and IN."""
    t = lambda n: D.table(spark, d, n)
    big = t("orders").where("o_totalprice > 100000")
    c = t("customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left_semi").join(t("nation").where("n_regionkey < 3"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 100000)")
def join_anti(spark, d):
    """NOT EXISTS."""
    urgent = D.table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 100000")
    return D.table(spark, d, "customer").join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query(D.with_(D.ARTICLE, D.PROMPT) + "SELECT prompt_id, count(*) AS pairs, count(*) FILTER (curated) AS curated_pairs FROM article, prompt WHERE enabled GROUP BY 1")
def join_cross_config(spark, d):
    """Every article with each row of a small configuration."""
    p = D.prompt(spark).where("enabled").select("prompt_id")
    return D.article(spark, d).select("curated").crossJoin(F.broadcast(p)).groupBy("prompt_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("curated").alias("curated_pairs"))


@query(D.with_(D.ARTICLE) + ", cfg AS (SELECT (SELECT count(*) FROM article WHERE curated AND year = 1800) AS linked, (SELECT count(*) FROM article WHERE route = 'src3') AS routed)\nSELECT article_id FROM article, cfg WHERE CASE WHEN linked > 0 THEN curated AND year = 1800 WHEN routed > 0 THEN route = 'src3' ELSE true END")
def join_scope_fallback(spark, d):
    """Linked articles win, else a route's, else all."""
    a = D.article(spark, d)
    linked, routed = F.col("curated") & (F.col("year") == 1800), F.col("route") == "src3"
    cfg = a.agg(F.count_if(linked).alias("n_linked"), F.count_if(routed).alias("n_routed"))  # one row
    pick = F.when(F.col("n_linked") > 0, linked).when(F.col("n_routed") > 0, routed).otherwise(F.lit(True))
    return a.crossJoin(F.broadcast(cfg)).where(pick).select("article_id")


@query("SELECT r.k AS chunk, count(*) AS n, min(o_orderkey) AS first_key FROM orders JOIN (SELECT k, k * 1000 AS lo, k * 1000 + 499 AS hi FROM (SELECT unnest(range(0, (SELECT max(o_orderkey) // 1000 + 1 FROM orders))) AS k)) r ON o_orderkey BETWEEN r.lo AND r.hi GROUP BY 1")
def join_range(spark, d):
    """Keys in one of many ranges, over the keys' whole span. Ranges of one width are found by division, an
    equi-join whose sides Catalyst weighs, as ranges grow with the span."""
    o = D.table(spark, d, "orders").select("o_orderkey").withColumn("cell", F.floor(F.col("o_orderkey") / 1000))
    r = o.agg(F.max("cell").alias("last")).select(F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("chunk")).select("chunk", (F.col("chunk") * 1000).alias("lo"), (F.col("chunk") * 1000 + 499).alias("hi"))
    x = o.join(r, (F.col("cell") == F.col("chunk")) & F.col("o_orderkey").between(F.col("lo"), F.col("hi")))
    return x.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


@query(D.with_(D.JUDGMENT) + "SELECT judgment_id, unnest(answer_list) AS member FROM judgment WHERE generation = 1 UNION ALL SELECT judgment_id, NULL FROM judgment WHERE generation = 1 AND (answer_list IS NULL OR len(answer_list) = 0)")
def join_lateral_outer(spark, d):
    """Unnest that keeps rows with null or empty lists."""
    return D.judgment(spark, d).where("generation = 1").select("judgment_id", F.explode_outer("answer_list").alias("member"))


@query(D.with_(D.JUDGMENT) + "SELECT judgment_id, unnest(answer_list) AS member FROM judgment")
def join_lateral_inner(spark, d):
    """Unnest that drops them."""
    return D.judgment(spark, d).select("judgment_id", F.explode("answer_list").alias("member"))


@query(D.with_(D.JUDGMENT) + "SELECT judgment_id, CASE WHEN answer_json IS NOT NULL THEN array_to_string(list_filter([trim(answer), 'yes'], lambda x: x <> ''), '|') END AS members FROM judgment")
def join_json_members(spark, d):
    """String members of JSON array text, in order; numbers are left out."""
    from ..functions.answers import json_strings

    m = F.filter(F.transform(json_strings(F.col("answer_json")), lambda x: F.trim(x)), lambda x: x != "")
    return D.judgment(spark, d).select("judgment_id", F.array_join(m, "|").alias("members"))


@query(D.with_(D.JUDGMENT) + "SELECT judgment_id FROM judgment j WHERE created_s = (SELECT max(created_s) FROM judgment k WHERE k.article_id = j.article_id)")
def join_latest_subquery(spark, d):
    """Rows at their key's greatest mark (ties stay)."""
    w = Window.partitionBy("article_id")
    return D.judgment(spark, d).withColumn("m", F.max("created_s").over(w)).where("created_s = m").select("judgment_id")


@query(D.with_(D.JUDGMENT) + "SELECT a.article_id, a.model_id, a.prompt_id AS left_prompt, b.prompt_id AS right_prompt FROM judgment a JOIN judgment b ON a.article_id = b.article_id AND a.model_id = b.model_id AND a.generation = b.generation AND a.answer = b.answer AND a.prompt_id < b.prompt_id WHERE a.answer <> ''")
def join_self_collisions(spark, d):
    """One business key under two prompts."""
    keys = ["article_id", "model_id", "generation", "answer"]
    j = D.judgment(spark, d).where("answer <> ''")
    a, b = (j.select(*keys, F.col("prompt_id").alias(f"{side}_prompt")) for side in ("left", "right"))
    return a.join(b, keys).where("left_prompt < right_prompt").drop("generation", "answer")


@query("""WITH c AS (SELECT page_id % 300 AS input, 0 AS rank, page_id AS id FROM pages WHERE page_id % 4 = 0 UNION ALL SELECT page_id % 300, 1, page_id FROM pages WHERE page_id % 4 = 1 UNION ALL SELECT page_id % 300, 2, page_id FROM pages WHERE page_id % 4 > 1),
b AS (SELECT *, min(rank) OVER (PARTITION BY input) AS best FROM c)
SELECT input, best::BIGINT AS best_rank, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS id FROM b WHERE rank = best GROUP BY 1, 2""")
def join_ranked_resolution(spark, d):
    """Best-ranked source of an id; null unless it is one."""
    p = D.table(spark, d, "pages").select("page_id", (F.col("page_id") % 300).alias("input"), (F.col("page_id") % 4).alias("m"))
    rank = F.when(F.col("m") == 0, 0).when(F.col("m") == 1, 1).otherwise(2)
    x = p.withColumn("rank", rank).withColumn("best_rank", F.min("rank").over(Window.partitionBy("input")).cast("long")).where("rank = best_rank")
    return x.groupBy("input", "best_rank").agg(F.when(F.count_distinct("page_id") == 1, F.min("page_id")).alias("id"))


@query("SELECT s_suppkey, round(coalesce(n.bal, s_acctbal), 2) AS balance FROM supplier LEFT JOIN (SELECT l_suppkey, sum(l_quantity) AS bal FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1) n ON s_suppkey = l_suppkey")
def join_update_from(spark, d):
    """UPDATE ... FROM as a left join with a replacement value."""
    n = D.table(spark, d, "lineitem").where("l_suppkey % 3 = 0").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("bal"))
    return D.table(spark, d, "supplier").join(n, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", F.round(F.coalesce("bal", "s_acctbal"), 2).alias("balance"))


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS before, b.n AS later FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n")
def join_full_outer(spark, d):
    """Two row sets compared."""
    o = D.table(spark, d, "orders")
    a = o.where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("before"))
    b = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("later"))
    return a.join(b, "k", "full").where(~F.col("before").eqNullSafe(F.col("later")))


@query("""WITH e AS (SELECT event_id, unnest(CASE event_id % 4 WHEN 0 THEN ['answer', 'quotes', 'k' || event_id] WHEN 1 THEN ['anwer', 'answer', 'quote'] WHEN 2 THEN ['explnation', 'answers', 'other', 'k' || event_id || 'x'] ELSE ['quotess', 'quote', 'answer'] END) AS found FROM events),
x AS (SELECT event_id, unnest(['answer', 'explanation', 'quotes', 'k' || event_id]) AS expected FROM events)
SELECT event_id, found, expected FROM (SELECT event_id, found, expected, levenshtein(found, expected) AS far FROM e JOIN x USING (event_id) WHERE levenshtein(found, expected) <= 1)
QUALIFY row_number() OVER (PARTITION BY event_id, expected ORDER BY far, CASE found WHEN 'quotess' THEN 0 ELSE 1 END) = 1""")
def join_fuzzy_keys(spark, d):
    """Keys of each record one edit apart, exact ones first, each expected key once."""
    i = F.col("event_id")
    own = F.concat(F.lit("k"), i.cast("string"))
    keys = lambda *names: F.array(*[n if isinstance(n, F.Column) else F.lit(n) for n in names])
    found = F.when(i % 4 == 0, keys("answer", "quotes", own)).when(i % 4 == 1, keys("anwer", "answer", "quote")).when(i % 4 == 2, keys("explnation", "answers", "other", F.concat(own, F.lit("x")))).otherwise(keys("quotess", "quote", "answer"))
    pairs = T.remapped(found, keys("answer", "explanation", "quotes", own))
    return D.table(spark, d, "events").select("event_id", F.inline(pairs))


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT unnest([1, 3, 5, 7]))")
def join_inline_ids(spark, d):
    """An inline id list as a relation; an empty list would be an empty relation."""
    ids = spark.createDataFrame([(i,) for i in (1, 3, 5, 7)], "s_suppkey long")
    return D.table(spark, d, "supplier").select("s_suppkey").join(F.broadcast(ids), "s_suppkey", "left_semi")
