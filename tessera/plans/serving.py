"""Queries of serving tables and incremental maintenance (F05, F07 postings, T01-T12, T18, D24, D26, X04, X06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters as L
from ..operators import serving as S
from ..registry import query
from . import contracts
from . import domain as D

_LEDGER = D.with_(D.LEDGER)


def _postings(spark, d, only: dict[str, list[str]] | None = None):
    """Posting lists of three facets; of the values that are asked for, where they are known."""
    a = D.article(spark, d)
    route, year, lang = (S.build_postings(a, k, k, only=(only or {}).get(k)) for k in ("route", "year", "lang"))
    return route.unionByName(year).unionByName(lang)


@query(D.with_(D.ARTICLE) + """SELECT k AS filter_kind, v AS filter_value, chunk, len(ids) AS n, sha256(array_to_string(ids, ',')) AS digest FROM (SELECT k, v, article_id // 4096 AS chunk, list_sort(list(DISTINCT article_id)) AS ids FROM (SELECT 'route' AS k, route AS v, article_id FROM article UNION ALL SELECT 'year', year::VARCHAR, article_id FROM article UNION ALL SELECT 'lang', lang, article_id FROM article) WHERE v IS NOT NULL GROUP BY 1, 2, 3)""")
def serve_postings(spark, d):
    """Posting lists by facet value and id range."""
    return _postings(spark, d).select("filter_kind", "filter_value", "chunk", F.size("ids").cast("long").alias("n"), F.sha2(F.array_join("ids", ","), 256).alias("digest"))


@query(D.with_(D.ARTICLE) + "SELECT article_id FROM article WHERE route IN ('src1', 'src2', 'src5') AND year IN (1995, 2001, 2002, 2010) AND lang IN ('en')")
def serve_posting_intersection(spark, d):
    """union in a group, intersection over groups."""
    wanted = {"route": ["src1", "src2", "src5"], "year": ["1995", "2001", "2002", "2010"], "lang": ["en"]}
    return S.intersect_postings(_postings(spark, d, wanted), list(wanted.items()))


@query("""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(strip_accents(split_part(text, chr(10), 1))), '[^a-z0-9]+')) AS token FROM documents)
SELECT token, doc_id // 4096 AS chunk, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM t WHERE token <> '' GROUP BY 1, 2""")
def serve_token_postings(spark, d):
    """Title-token postings (ids sorted as numbers) of all articles, by id range."""
    t = D.article(spark, d).select("article_id", F.explode(T.title_tokens(F.col("title"))).alias("token"))
    return S.build_postings(t, "token", "token").select(F.col("filter_value").alias("token"), "chunk", F.array_join("ids", ",").alias("ids"))


@query(_LEDGER + "SELECT idempotency_key, min(event_id) AS event_id FROM ledger WHERE event_id >= 1000 AND idempotency_key NOT IN (SELECT idempotency_key FROM ledger WHERE event_id < 1000) GROUP BY 1")
def ledger_append_once(spark, d):
    """An append adds the first of each key not yet there."""
    x = D.ledger(spark, d)
    return S.append_once(x.where("event_id < 1000"), x.where("event_id >= 1000")).select("idempotency_key", "event_id")


@query(_LEDGER + "SELECT event_id, partition_id, row_number() OVER (PARTITION BY partition_id ORDER BY event_id) AS mark FROM ledger")
def ledger_marks(spark, d):
    """Gapless marks per partition."""
    return S.high_water_marks(D.ledger(spark, d)).select("event_id", "partition_id", "mark")


@query(_LEDGER + """, rule(k, c) AS (VALUES ('article_added', ['base', 'title_search', 'counts']), ('article_updated', ['base', 'title_search']), ('article_deleted', ['base', 'title_search', 'counts', 'postings']), ('llm_judged', ['llm_status', 'postings', 'counts', 'queue']), ('human_judged', ['human_status', 'postings', 'counts', 'queue'])), r AS (SELECT k, unnest(c) AS component FROM rule)
SELECT component, count(*) AS n FROM ledger JOIN r ON change_kind = k GROUP BY 1""")
def ledger_fan_out(spark, d):
    """Changes by the components that they make stale."""
    return S.fan_out(D.ledger(spark, d)).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@query(_LEDGER + "SELECT partition_id, article_id, min(event_id) AS first_mark, max(event_id) AS latest_mark, count(*) AS changes FROM ledger GROUP BY 1, 2")
def ledger_coalesce(spark, d):
    """One pending row per scope."""
    return S.coalesce_dirty(D.ledger(spark, d), ["partition_id", "article_id"])


@query(_LEDGER + "SELECT event_id % 7 AS slot, count(*) AS n FROM ledger WHERE event_id % 4 = 0 OR (event_id % 4 IN (1, 2) AND 1000 + event_id < 5000 - 900) GROUP BY 1")
def ledger_claimable(spark, d):
    """Pending work, and work whose lease has run out."""
    i = F.col("event_id")
    work = D.ledger(spark, d).select("event_id", F.when(i % 4 == 0, "pending").when(i % 4 == 1, "running").when(i % 4 == 2, "failed").otherwise("done").alias("status"), (1000 + i).alias("claimed_s"))
    return S.claimable(work, 5000).groupBy((i % 7).alias("slot")).agg(F.count(F.lit(1)).alias("n"))


@query(_LEDGER + ", done AS (SELECT partition_id, max(event_id) AS mark FROM ledger WHERE event_id < 5000 GROUP BY 1) SELECT l.event_id FROM ledger l JOIN done d USING (partition_id) WHERE l.event_id > d.mark AND l.event_id % 9 = 0")
def ledger_compact(spark, d):
    """Acknowledgements at or below the completed mark go."""
    x = D.ledger(spark, d)
    done = x.where("event_id < 5000").groupBy("partition_id").agg(F.max("event_id").alias("done"))
    return x.where("event_id % 9 = 0").join(done, "partition_id").where("event_id > done").select("event_id")


@query(_LEDGER + ", m AS (SELECT *, row_number() OVER (PARTITION BY partition_id ORDER BY event_id) AS mark FROM ledger) SELECT partition_id, coalesce(min(mark) FILTER (event_id % 301 = 7) - 1, max(mark)) AS may_reach FROM m GROUP BY 1")
def ledger_barrier(spark, d):
    """A projector doesn't pass an unreconciled row."""
    m = S.high_water_marks(D.ledger(spark, d))
    return S.barrier(m.where("event_id % 301 = 7"), m)


@query(_LEDGER + "SELECT article_id, event_id, change_kind FROM (SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY event_id DESC) = 1) WHERE NOT tombstone")
def ledger_latest(spark, d):
    """The latest change of each article, tombstones dropped."""
    return S.latest_by_mark(D.ledger(spark, d)).select("article_id", "event_id", "change_kind")


@query(D.with_(D.ARTICLE) + ", o AS (SELECT article_id % 100 AS article_id, 'w' || article_id AS title, article_id AS written_s FROM article WHERE article_id % 3 = 0 AND article_id + 500 > 1000 QUALIFY row_number() OVER (PARTITION BY article_id % 100 ORDER BY article_id DESC) = 1)\nSELECT a.article_id, coalesce(o.title, a.title) AS title FROM article a LEFT JOIN o USING (article_id)")
def serve_overlay(spark, d):
    """Read-your-write overlays."""
    a = D.article(spark, d).select("article_id", "title")
    i = F.col("article_id")
    pending = a.select((i % 100).alias("article_id"), F.concat(F.lit("w"), i.cast("string")).alias("title"), i.alias("written_s"), (i + 500).alias("expires_s"), F.when(i % 3 == 0, "pending").otherwise("reconciled").alias("status"))
    return S.overlay(a, pending, "article_id", "title", 1000)


@query(D.with_(D.ARTICLE) + "SELECT 'year' AS filter_kind, year::VARCHAR AS filter_value, count(*) AS n FROM article WHERE year IN (1999, 2005) GROUP BY 2")
def serve_lazy_postings(spark, d):
    """Only postings that the cache lacks are computed, and appended."""
    a = D.article(spark, d).withColumn("year", F.col("year").cast("string"))
    cached = S.build_postings(a.where("year = '1999'"), "year", "year")
    wanted = spark.createDataFrame([("1999",), ("2005",)], "filter_value string")
    missing = wanted.join(cached, "filter_value", "left_anti")
    fresh = S.build_postings(a.join(F.broadcast(missing), a.year == missing.filter_value, "left_semi"), "year", "year")  # no more rows than a request names values
    return cached.unionByName(fresh).groupBy("filter_kind", "filter_value").agg(F.sum(F.size("ids")).cast("long").alias("n"))


@query(D.with_(D.ARTICLE) + """, p AS (SELECT 'route' AS k, route AS v, article_id FROM article WHERE article_id % 7 <> 0), c AS (SELECT 'route' AS k, route AS v, article_id, article_id % 2 = 0 AS add FROM article WHERE article_id % 7 IN (0, 1))
SELECT k AS filter_kind, v AS filter_value, count(*) AS n FROM (SELECT * FROM p WHERE (k, v, article_id) NOT IN (SELECT (k, v, article_id) FROM c WHERE NOT add) UNION SELECT k, v, article_id FROM c WHERE add) GROUP BY 1, 2""")
def serve_posting_changes(spark, d):
    """U04 applied to stored lists: ids join and leave."""
    a = D.article(spark, d)
    changes = a.where("article_id % 7 in (0, 1)").select(F.lit("route").alias("filter_kind"), F.col("route").alias("filter_value"), "article_id", (F.col("article_id") % 2 == 0).alias("add"))
    return S.apply_posting_changes(S.build_postings(a.where("article_id % 7 <> 0"), "route", "route"), changes).groupBy("filter_kind", "filter_value").agg(F.sum(F.size("ids")).cast("long").alias("n"))


@query(D.with_(D.ARTICLE, D.JUDGMENT) + "SELECT a.article_id FROM article a WHERE route IN ('src1', 'src3') AND contains(lower(title), 'th') AND EXISTS (SELECT 1 FROM judgment j WHERE j.article_id = a.article_id AND prompt_id = 1 AND answer IN ('Yes', 'maybe'))")
def serve_bulk_selection(spark, d):
    """The ids of a combined filter."""
    a = D.article(spark, d).where(F.col("route").isin("src1", "src3") & L.contains_text(F.col("title"), "TH"))
    j = D.judgment(spark, d).where((F.col("prompt_id") == 1) & F.col("answer").isin("Yes", "maybe"))
    return a.join(j, "article_id", "left_semi").select("article_id")


@query(D.with_(D.ARTICLE, D.JUDGMENT) + "SELECT 'null_status' AS gate, count(*) FILTER (has_human IS NULL) AS failures FROM article UNION ALL SELECT 'unknown_article', count(*) FROM judgment j WHERE NOT EXISTS (SELECT 1 FROM article a WHERE a.article_id = j.article_id) UNION ALL SELECT 'repeated_key', count(*) FROM (SELECT 1 FROM judgment GROUP BY article_id, model_id, prompt_id, generation HAVING count(*) > 1)")
def serve_validation_gates(spark, d):
    """Assertions before a promotion."""
    a, j = D.article(spark, d), D.judgment(spark, d)
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("gate"), "failures")
    return one("null_status", a.where("has_human is null")).unionByName(one("unknown_article", j.join(a, "article_id", "left_anti"))).unionByName(one("repeated_key", j.groupBy("article_id", "model_id", "prompt_id", "generation").count().where("count > 1")))


@query("""WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'articles.list' WHEN 1 THEN 'articles.export' WHEN 2 THEN 'queue.unassessed' ELSE 'nothing' END AS contract, event_id * 37 % 1300 - 20 AS row_limit,
  CASE event_id % 5 WHEN 0 THEN 'route' WHEN 1 THEN 'year' WHEN 2 THEN 'prompt_id' ELSE 'colour' END AS filter, CASE WHEN event_id % 7 = 3 THEN 'stale' ELSE 'ready' END AS freshness, CASE event_id % 11 WHEN 4 THEN 'substring' WHEN 5 THEN 'prefix' ELSE 'none' END AS search_mode FROM events)
SELECT event_id, contract, CASE WHEN contract = 'nothing' THEN 'unknown contract' WHEN filter = 'colour' OR (filter = 'prompt_id') <> (contract = 'queue.unassessed') THEN 'unknown filter' WHEN row_limit > CASE contract WHEN 'articles.export' THEN 100000 ELSE 500 END THEN 'page too large' WHEN row_limit <= 0 THEN 'empty page'
  WHEN freshness = 'stale' AND contract <> 'articles.export' THEN 'not ready' WHEN search_mode = 'substring' THEN 'substring search is a job' ELSE 'accept' END AS decision FROM r""")
def serve_admission(spark, d):
    """Requests and whether their contracts admit them."""
    i = F.col("event_id")

    def pick(n: int, values: dict[int, str], other: str):
        names = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
        return F.coalesce(F.element_at(names, (i % n).cast("int")), F.lit(other))

    requests = D.table(spark, d, "events").select(
        "event_id", pick(4, {0: "articles.list", 1: "articles.export", 2: "queue.unassessed"}, "nothing").alias("contract"), (i * 37 % 1300 - 20).alias("row_limit"),
        F.array(pick(5, {0: "route", 1: "year", 2: "prompt_id"}, "colour")).alias("filters"), pick(7, {3: "stale"}, "ready").alias("freshness"), pick(11, {4: "substring", 5: "prefix"}, "none").alias("search_mode"),
    )
    return contracts.admitted(requests).select("event_id", "contract", "decision")


@query(D.with_(D.ARTICLE) + "SELECT article_id, title, created_s FROM article WHERE route IN ('src2') AND has_llm ORDER BY created_s DESC, article_id DESC LIMIT 26")
def serve_contract_read(spark, d):
    """A read assembled from its contract."""
    return contracts.read("articles.list", D.article(spark, d), {"route": ["src2"], "has_llm": [True]}, limit=25)
