"""Queries of sources, sinks and text operators (S01-S14, K01-K05, D15-D20, A09 digests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..sources import sinks
from . import domain as D


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 150000")
def scan_pushdown(spark, d):
    """Filter and columns reach the Parquet scan."""
    return D.table(spark, d, "orders").where("o_orderstatus = 'P' and o_totalprice > 150000").select("o_orderkey", "o_totalprice")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE (props->>'$.k')::BIGINT > 90")
def scan_json_payload(spark, d):
    """JSON text parsed to a schema."""
    e = D.table(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("p"))
    return e.select("event_id", F.col("p.k").alias("k")).where("k > 90")


@query(D.with_(D.ARTICLE, D.JUDGMENT, D.LATEST) + """, a AS (SELECT article_id, prompt_id, min(answer) AS answer FROM latest WHERE model_id = 1 GROUP BY 1, 2)
SELECT article_id, route, max(answer) FILTER (prompt_id = 1) AS prompt_1, max(answer) FILTER (prompt_id = 3) AS prompt_3 FROM article LEFT JOIN a USING (article_id) GROUP BY 1, 2""")
def export_wide(spark, d):
    """One answer column per prompt."""
    from ..operators.compare import latest

    j = latest(D.judgment(spark, d), ["article_id", "model_id", "prompt_id"], [F.desc("created_s"), F.desc("judgment_id")]).where("model_id = 1")
    return sinks.wide_export(D.article(spark, d), j, [1, 3], ["route"])


@query("SELECT p_partkey, p_partkey || ',' || CASE WHEN p_partkey % 5 = 0 THEN '\"a \"\"' || p_name || '\"\"\"' ELSE p_name END || ',' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '\"' || p_brand || ', x\"' END AS line FROM part")
def export_csv_lines(spark, d):
    """Cells are quoted only where they must be."""
    k = F.col("p_partkey")
    x = D.table(spark, d, "part").select("p_partkey", k.alias("key"), F.when(k % 5 == 0, F.concat(F.lit('a "'), "p_name", F.lit('"'))).otherwise(F.col("p_name")).alias("name"), F.when(k % 3 != 0, F.concat("p_brand", F.lit(", x"))).alias("brand"))
    return x.select("p_partkey", F.concat_ws(",", *[sinks.csv_cell(F.col(c)) for c in ("key", "name", "brand")]).alias("line"))


@query("SELECT count(*) AS rows FROM nation")
def export_fingerprint(spark, d):
    """A fingerprint that doesn't depend on row order."""
    n = D.table(spark, d, "nation")
    a, b = sinks.fingerprint(n), sinks.fingerprint(n.orderBy(F.desc("n_name")).repartition(5))
    return a.join(b, ["rows", "digest"]).select("rows")


@query("SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'new' WHEN n_nationkey % 5 = 1 THEN 'conflict' WHEN n_nationkey % 5 = 2 THEN 'repeated' ELSE 'same' END AS outcome FROM nation")
def import_analysis(spark, d):
    """New, same, conflicting and repeated ids of a package."""
    n = D.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    existing = n.where("id % 5 <> 0").select("id", F.when(F.col("id") % 5 == 1, "other").otherwise(F.col("name")).alias("name"))
    return sinks.analyze_import(n.unionByName(n.where("id % 5 = 2")), existing)


@query("SELECT 'append' AS what, count(*) AS n FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'mismatch', count(*) FROM supplier WHERE s_suppkey % 3 = 1")
def import_insert_once(spark, d):
    """What is appended, and what doesn't agree with the stored row."""
    s = D.table(spark, d, "supplier").select("s_suppkey", "s_name")
    target = s.where("s_suppkey % 3 <> 0").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 1, None).otherwise(F.col("s_name")).alias("s_name"))
    add, bad = sinks.insert_once(target, s, "s_suppkey")
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    return one("append", add).unionByName(one("mismatch", bad))


@query("SELECT conv_id, '# Patient ' || conv_id || chr(10) || chr(10) || string_agg('### ' || role || chr(10) || body, chr(10) || chr(10) ORDER BY role) AS markdown FROM (SELECT conv_id, role, string_agg('- ' || lpad(turn::VARCHAR, 4, '0') || ' r' || turn, chr(10) ORDER BY turn) AS body FROM (SELECT DISTINCT conv_id, role, turn FROM conversations) GROUP BY 1, 2) GROUP BY 1")
def export_timelines(spark, d):
    """A document per group, sections by type, entries by time."""
    from ..sources.files import patient_timelines

    c = D.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("patient_id"), F.col("role").alias("resource_type"), F.concat(F.lit("r"), F.col("turn").cast("string")).alias("resource_id"), F.lpad(F.col("turn").cast("string"), 4, "0").alias("time"), F.lit(None).cast("string").alias("text")).distinct()
    return patient_timelines(c).select(F.col("patient_id").cast("long").alias("conv_id"), "markdown")


@query("SELECT event_id, '{\"k\":' || (props->>'$.k') || CASE WHEN event_id % 3 = 0 THEN ',\"v\":1}' ELSE '}' END AS merged FROM events")
def text_merge_patch(spark, d):
    """RFC 7396 merges, null deletes."""
    patch = F.when(F.col("event_id") % 3 == 0, F.lit('{"v": 1, "gone": null}')).otherwise(F.lit('{"gone": null}'))
    return D.table(spark, d, "events").select("event_id", T.merge_patch_udf("props", patch).alias("merged"))


@query("SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '(?m)^#{1,6} ') THEN 'article_heading_greedy' ELSE 'article_paragraph_greedy' END AS strategy, sha256(coalesce(text, '')) AS rejoined, true AS fits, true AS full FROM documents")
def text_chunks(spark, d):
    """Greedy chunks of at most 1500 characters: joined they are the text, and no two neighbours fit into one."""
    x = D.table(spark, d, "documents").select("doc_id", T.chunks_udf(1500)("text").alias("c")).select("doc_id", "c.*")
    sizes = F.transform("chunks", lambda t: F.length(t))
    pairs = F.zip_with(F.slice(sizes, 1, F.greatest(F.lit(0), F.size(sizes) - 1)), F.slice(sizes, 2, F.size(sizes)), lambda a, b: a + b)
    return x.select("doc_id", "strategy", F.sha2(F.array_join("chunks", ""), 256).alias("rejoined"), F.forall(sizes, lambda n: n <= 1500).alias("fits"), F.forall(pairs, lambda n: n > 1500).alias("full"))


@query("SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens, ceil(length(text) / 4.0) <= 500 AS fits FROM documents")
def text_token_estimate(spark, d):
    """Four characters a token."""
    n = T.approx_tokens(F.col("text"))
    return D.table(spark, d, "documents").select("doc_id", n.alias("tokens"), (n <= 500).alias("fits"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'plain' WHEN 1 THEN 'extracted' WHEN 2 THEN 'repaired' ELSE 'failed' END AS how, CASE WHEN event_id % 4 < 3 THEN event_id % 10 END AS answer FROM events")
def text_tolerant_json(spark, d):
    """Model output as is, out of a fence, or with its backslashes repaired."""
    i = F.col("event_id")
    body = F.concat(F.lit('{"answer": '), (i % 10).cast("string"), F.when(i % 4 == 2, r', "x": "\varphi"}').otherwise("}"))
    raw = F.when(i % 4 == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(i % 4 == 3, F.lit("no answer")).otherwise(body)
    x = D.table(spark, d, "events").select("event_id", T.tolerant_json_udf(raw).alias("p"))
    return x.select("event_id", F.col("p.how").alias("how"), F.get_json_object("p.json", "$.answer").cast("long").alias("answer"))


@query("WITH q AS (SELECT doc_id, [substr(t, length(t) // 2 + 1, 20), right(t, 20)] AS q FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))\nSELECT doc_id, len(list_distinct(list_filter(q, lambda x: regexp_replace(x, '\\s+', '', 'g') <> '')))::BIGINT AS valid FROM q")
def text_quotes(spark, d):
    """Quotes that occur in the text, white space and case aside."""
    x = D.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    spaced = lambda c: F.replace(c, F.lit(" "), F.lit("\n  "))
    middle, end = F.substring("t", F.floor(F.length("t") / 2).cast("int") + 1, F.lit(20)), F.right("t", F.lit(20))
    return x.select("doc_id", F.size(T.valid_quotes(F.col("t"), F.array(spaced(middle), F.lit("certainly not in there"), spaced(end)))).cast("long").alias("valid"))


@query("SELECT page_id, regexp_replace('a ![x](data:image/png;base64,AA' || page_id || ') b ![y](http://z/' || page_id || '.png)', '!\\[[^\\]]*\\]\\(data:image/[^)]*\\)', '', 'g') AS text FROM pages")
def text_strip_images(spark, d):
    """Inlined images go, links stay."""
    p = F.col("page_id").cast("string")
    raw = F.concat(F.lit("a ![x](data:image/png;base64,AA"), p, F.lit(") b ![y](http://z/"), p, F.lit(".png)"))
    return D.table(spark, d, "pages").select("page_id", T.strip_images(raw).alias("text"))
