"""Queries of aggregation (A01-A09, A11, A23-A34) and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as G
from ..operators.serving import build_postings
from ..registry import query
from . import domain as D


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, min(l_linenumber)::BIGINT AS low, max(l_linenumber)::BIGINT AS high, round(avg(l_extendedprice), 4) AS mean_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1, 2")
def agg_basic(spark, d):
    """Count, sum, min, max, avg."""
    li = D.table(spark, d, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.min("l_linenumber").cast("long").alias("low"), F.max("l_linenumber").cast("long").alias("high"),
        F.round(F.avg("l_extendedprice"), 4).alias("mean_price"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
    )


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_custkey) FILTER (o_totalprice > 200000) AS big_customers FROM orders GROUP BY 1")
def agg_count_distinct(spark, d):
    """Distinct counts, filtered too."""
    return D.table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct(F.when(F.col("o_totalprice") > 200000, F.col("o_custkey"))).alias("big_customers"))


@query("SELECT event_type, count(*) FILTER (value > 100) AS high, sum(CASE WHEN value <= 10 THEN 1 ELSE 0 END)::BIGINT AS low, bool_or(value > 400) AS any_huge FROM events GROUP BY 1")
def agg_filtered(spark, d):
    """FILTER, conditional sums, BOOL_OR."""
    e = D.table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count_if(F.col("value") > 100).alias("high"), F.sum(F.when(F.col("value") <= 10, 1).otherwise(0)).alias("low"), F.bool_or(F.col("value") > 400).alias("any_huge"))


@query("SELECT n_regionkey::BIGINT AS region, any_value(r_name) AS name, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def agg_any_value_list(spark, d):
    """A functionally dependent column, and an ordered distinct list."""
    x = D.table(spark, d, "nation").join(D.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.groupBy(F.col("n_regionkey").cast("long").alias("region")).agg(F.min("r_name").alias("name"), F.array_join(G.ordered_distinct("n_name"), ",").alias("nations"))


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn, role) AS roles FROM conversations GROUP BY 1")
def agg_ordered_array(spark, d):
    """Values in another column's order."""
    return D.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(G.ordered_list("role", "turn"), ">").alias("roles"))


@query("SELECT c_mktsegment, sha256(coalesce(string_agg(c_name, '|' ORDER BY c_name) FILTER (c_acctbal < 0), '')) AS checksum FROM customer GROUP BY 1")
def agg_checksum(spark, d):
    """Proof of a materialised list; an empty one hashes the empty text."""
    c = D.table(spark, d, "customer").select("c_mktsegment", F.when(F.col("c_acctbal") < 0, F.col("c_name")).alias("name"))
    return c.groupBy("c_mktsegment").agg(G.checksum("name").alias("checksum"))


@query("SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1 HAVING count(*) >= 7")
def agg_having(spark, d):
    """A condition on the aggregate."""
    return D.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines")).where("lines >= 7")


@query(D.with_(D.ARTICLE) + """SELECT k AS facet_key, sum(v)::BIGINT AS count_value FROM (
  SELECT 'total' AS k, 1 AS v FROM article UNION ALL SELECT 'llm', 1 FROM article WHERE has_llm UNION ALL SELECT 'human', 1 FROM article WHERE has_human UNION ALL SELECT 'duplicate', 1 FROM article WHERE duplicate
  UNION ALL SELECT 'conflict', 1 FROM article WHERE conflict UNION ALL SELECT 'lang:' || lang, 1 FROM article UNION ALL SELECT 'unassessed', 1 FROM article WHERE has_llm IS NOT TRUE AND has_human IS NOT TRUE) GROUP BY 1""")
def agg_named_counts(spark, d):
    """Named counts and facets. One pass emits each article's keys; nothing is scanned twice."""
    c = F.col
    keys = F.array_compact(F.array(
        F.lit("total"), F.when(c("has_llm"), "llm"), F.when(c("has_human"), "human"), F.when(c("duplicate"), "duplicate"), F.when(c("conflict"), "conflict"), F.concat(F.lit("lang:"), c("lang")),
        F.when(~c("has_llm").eqNullSafe(F.lit(True)) & ~c("has_human").eqNullSafe(F.lit(True)), "unassessed"),
    ))
    return D.article(spark, d).select(F.explode(keys).alias("facet_key")).groupBy("facet_key").agg(F.count(F.lit(1)).alias("count_value"))


@query(D.with_(D.ARTICLE) + ", o AS (SELECT route, year, count(*) AS v FROM article WHERE article_id % 10 <> 3 GROUP BY 1, 2), n AS (SELECT route, year, count(*) AS v FROM article WHERE article_id % 10 <> 4 GROUP BY 1, 2)\nSELECT route, year, sum(v)::BIGINT AS delta FROM (SELECT route, year, v FROM n UNION ALL SELECT route, year, -v FROM o) GROUP BY 1, 2 HAVING sum(v) <> 0")
def agg_contribution_diff(spark, d):
    """What changes between two sets of contributions."""
    a = D.article(spark, d)
    part = lambda m: a.where(F.col("article_id") % 10 != m).groupBy("route", "year").agg(F.count(F.lit(1)).alias("v"))
    return G.contribution_diff(part(3), part(4), ["route", "year"], "v")


@query(D.with_(D.ARTICLE) + "SELECT route, CASE WHEN route < 'src15' THEN 'ready' ELSE 'indexing' END AS availability, CASE WHEN route < 'src15' THEN count(*) END AS count_value FROM article GROUP BY 1")
def agg_gated_counts(spark, d):
    """A count is null, not 0, unless it is available."""
    ready = F.when(F.col("route") < "src15", "ready").otherwise("indexing")
    g = D.article(spark, d).groupBy("route").agg(F.count(F.lit(1)).alias("n"))
    return g.select("route", ready.alias("availability"), F.when(ready == "ready", F.col("n")).alias("count_value"))


@query(D.with_(D.ARTICLE, D.JUDGMENT) + "SELECT count(DISTINCT a.article_id) AS n FROM article a WHERE a.year > 2000 AND has_llm AND EXISTS (SELECT 1 FROM judgment j WHERE j.article_id = a.article_id AND prompt_id = 1 AND answer = 'Yes') AND EXISTS (SELECT 1 FROM judgment j WHERE j.article_id = a.article_id AND prompt_id = 2 AND answer IN ('no', 'maybe'))")
def agg_dynamic_count(spark, d):
    """A filtered count as filters and semi-joins."""
    j = D.judgment(spark, d)
    a = D.article(spark, d).where("year > 2000 and has_llm").select("article_id")
    for p, values in ((1, ["Yes"]), (2, ["no", "maybe"])):
        a = a.join(j.where((F.col("prompt_id") == p) & F.col("answer").isin(values)), "article_id", "left_semi")
    return a.agg(F.count_distinct("article_id").alias("n"))


@query(D.with_(D.JUDGMENT) + ", m AS (SELECT article_id, prompt_id, unnest(coalesce(answer_list, [answer])) AS a FROM judgment) SELECT prompt_id, trim(a) AS option, count(DISTINCT article_id) AS articles FROM m WHERE trim(a) <> '' GROUP BY 1, 2")
def agg_filter_options(spark, d):
    """Answer values of each prompt with article counts; blanks dropped."""
    m = D.judgment(spark, d).select("article_id", "prompt_id", F.explode(F.coalesce("answer_list", F.array("answer"))).alias("option")).withColumn("option", F.trim("option")).where("option <> ''")
    return m.groupBy("prompt_id", "option").agg(F.count_distinct("article_id").alias("articles"))


@query("WITH e AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents), w AS (SELECT *, CASE WHEN hi - lo < 10 THEN 1 ELSE ceil((hi - lo + 1) / 10.0)::BIGINT END AS w FROM e), b AS (SELECT lo + ((n_chars - lo) // w) * w AS low, hi, w FROM documents, w)\nSELECT low, least(low + w - 1, hi) AS high, count(*) AS n FROM b GROUP BY low, hi, w")
def agg_equal_width_bins(spark, d):
    """Integer bins of one width."""
    return G.equal_width_bins(D.table(spark, d, "documents"), "n_chars")


@query("""WITH v AS (SELECT DISTINCT n_chars AS v FROM documents), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS rn, count(*) OVER () AS total FROM v),
q AS (SELECT *, max(CASE WHEN rn = floor(total * 0.25) THEN v END) OVER () AS q1, max(CASE WHEN rn = floor(total * 0.75) THEN v END) OVER () AS q3 FROM r),
k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS nk FROM q WHERE total < 4 OR (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)))
SELECT (k // CASE WHEN nk <= 10 THEN 1 ELSE ceil(nk / 10.0)::BIGINT END)::BIGINT AS bin, min(v) AS low, max(v) AS high, count(*) AS n FROM k GROUP BY 1""")
def agg_quantile_bins(spark, d):
    """Bins of equal counts without outliers."""
    return G.quantile_bins(D.table(spark, d, "documents"), "n_chars")


@query("SELECT p_brand, p_type, p_size::BIGINT AS p_size, count(*) AS copies, min(p_partkey) AS keep FROM part GROUP BY ALL HAVING count(*) > 1")
def agg_duplicate_groups(spark, d):
    """Groups that agree in all of some columns."""
    return D.table(spark, d, "part").groupBy("p_brand", "p_type", F.col("p_size").cast("long").alias("p_size")).agg(F.count(F.lit(1)).alias("copies"), F.min("p_partkey").alias("keep")).where("copies > 1")


@query("SELECT event_type, event_id % 3 AS slice, count(DISTINCT user_id) AS exact, 0::BIGINT AS error_class FROM events GROUP BY 1, 2")
def agg_approx_distinct(spark, d):
    """The sketch's error against the exact count, in classes of four times its stated relative error."""
    e = D.table(spark, d, "events").groupBy("event_type", (F.col("event_id") % 3).alias("slice")).agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count_distinct("user_id").alias("exact"))
    return e.select("event_type", "slice", "exact", F.floor(F.abs(F.col("a") - F.col("exact")) / (0.08 * F.col("exact") + 1)).alias("error_class"))


@query(D.with_(D.JUDGMENT) + "SELECT prompt_id, sum(CASE WHEN answer_json IS NOT NULL THEN 3 ELSE 0 END)::BIGINT AS members FROM judgment GROUP BY 1")
def agg_json_lengths(spark, d):
    """Lengths of JSON arrays summed."""
    return D.judgment(spark, d).groupBy("prompt_id").agg(F.sum(F.coalesce(F.json_array_length("answer_json"), F.lit(0))).cast("long").alias("members"))


@query(D.with_(D.ARTICLE) + "SELECT count(DISTINCT article_id) AS total FROM (SELECT article_id FROM article WHERE curated UNION ALL SELECT article_id FROM article WHERE route IN ('src0', 'src1') AND created_s >= 1704067200 AND created_s <= 1712000000)")
def agg_scope_totals(spark, d):
    """Curated articles, and those of a route in an inclusive date range."""
    a = D.article(spark, d)
    routed = F.col("route").isin("src0", "src1") & F.col("created_s").between(1704067200, 1712000000)
    return a.where("curated").select("article_id").unionByName(a.where(routed).select("article_id")).agg(F.count_distinct("article_id").alias("total"))


@query("SELECT c_nationkey::BIGINT AS nation FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def set_union(spark, d):
    """Distinct union."""
    c = D.table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").cast("long").alias("nation"))
    s = D.table(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").cast("long").alias("nation"))
    return c.union(s).distinct()


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def set_distinct(spark, d):
    """Distinct rows."""
    return D.table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("""WITH p AS (SELECT route, doc_id // 4096 AS chunk, list_sort(list(doc_id)) AS ids FROM (SELECT source AS route, doc_id FROM documents) GROUP BY 1, 2),
u AS (SELECT route, chunk, list_sort(list_distinct(list_concat(list_filter(ids, lambda x: x % 3 <> 0), CASE WHEN chunk = 0 THEN [1, 2, 5] ELSE []::INTEGER[] END))) AS ids FROM p)
SELECT route, chunk, array_to_string(ids, ',') AS ids FROM u WHERE len(ids) > 0""")
def set_posting_update(spark, d):
    """Ids leave and join posting lists, which stay sorted and distinct; empty ones go. Lists come in chunks by
    id range, so that none is longer than its range."""
    p = build_postings(D.table(spark, d, "documents"), "source", "source", "doc_id").withColumnRenamed("filter_value", "route")
    gone = F.filter("ids", lambda x: x % 3 == 0)
    add = F.when(F.col("chunk") == 0, F.array(*[F.lit(i).cast("long") for i in (1, 2, 5)])).otherwise(F.array().cast("array<bigint>"))
    ids = F.array_sort(F.array_distinct(F.concat(F.array_except("ids", gone), add)))
    return p.select("route", "chunk", ids.alias("ids")).where(F.size("ids") > 0).select("route", "chunk", F.array_join("ids", ",").alias("ids"))
