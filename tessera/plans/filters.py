"""Queries of projection, filters and search (F01-F22, K01 pivot aside)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as T
from ..operators import filters as L
from ..registry import query
from . import domain as D

_A = D.with_(D.ARTICLE)


@query(_A + "SELECT article_id, year FROM article WHERE year = 2001 AND route IN ('src1', 'src2', 'src3') AND created_s >= 1704067200 AND created_s < epoch(TIMESTAMP '2024-07-01')::BIGINT AND duplicate = false")
def filter_columns(spark, d):
    """year, route, half-open date range, duplicate flag."""
    a = D.article(spark, d)
    return a.where((F.col("year") == 2001) & F.col("route").isin("src1", "src2", "src3") & L.date_range(F.col("created_s"), "2024-01-01", "2024-06-30") & ~F.col("duplicate")).select("article_id", "year")


@query(_A + "SELECT article_id FROM article WHERE duplicate IN (true) AND has_human IN (true)")
def filter_state_groups(spark, d):
    """OR in a group, AND between groups; both booleans filter nothing."""
    return D.article(spark, d).where(L.state_filter({"duplicate": [True], "has_human": [True], "has_llm": [True, False], "conflict": []})).select("article_id")


@query(_A + """SELECT m AS list_mode_key, count(*) AS n FROM (SELECT unnest(['llm', 'human', 'both', 'unassessed']) AS m), article
WHERE CASE m WHEN 'llm' THEN has_llm WHEN 'human' THEN has_human WHEN 'both' THEN has_llm AND has_human ELSE has_llm IS NOT TRUE AND has_human IS NOT TRUE END IS TRUE GROUP BY 1""")
def filter_list_modes(spark, d):
    """list-mode flags unpivoted to one row each."""
    modes = L.list_modes(F.col("has_llm"), F.col("has_human"))
    a = D.article(spark, d).select("article_id", *[v.alias(k) for k, v in modes.items()])
    return a.unpivot("article_id", list(modes), "list_mode_key", "has").where("has").groupBy("list_mode_key").agg(F.count(F.lit(1)).alias("n"))


@query(D.with_(D.JUDGMENT) + """, want(p, a, k) AS (VALUES (1, 'Yes', 0), (1, 'maybe', 0), (2, 'no', 1))
SELECT article_id FROM judgment JOIN want ON prompt_id = p AND answer = a GROUP BY 1 HAVING count(DISTINCT k) = 2""")
def filter_prompt_answers(spark, d):
    """Articles that match every chosen prompt by any of its values."""
    want = spark.createDataFrame([(1, "Yes", 0), (1, "maybe", 0), (2, "no", 1)], "prompt_id long, answer string, k int")
    return L.divide(D.judgment(spark, d).join(F.broadcast(want), ["prompt_id", "answer"]), "article_id", "k", 2)  # a row for each value asked for


_TOKENS = _A + """, tok AS (SELECT DISTINCT article_id, unnest(regexp_split_to_array(lower(strip_accents(title)), '[^a-z0-9]+')) AS token FROM article)
"""


@query(_TOKENS + "SELECT token, count(DISTINCT article_id) AS articles FROM tok WHERE token <> '' GROUP BY 1")
def search_title_tokens(spark, d):
    """title tokens (accent-free, lower-case) with their article counts."""
    a = D.article(spark, d).select("article_id", F.explode(T.title_tokens(F.col("title"))).alias("token"))
    return a.groupBy("token").agg(F.count_distinct("article_id").alias("articles"))


@query(_TOKENS + "SELECT article_id FROM tok WHERE starts_with(token, 'th') OR starts_with(token, 'er') GROUP BY 1 HAVING bool_or(starts_with(token, 'th')) AND bool_or(starts_with(token, 'er'))")
def search_title_prefixes(spark, d):
    """Every query prefix starts some title token."""
    a = D.article(spark, d).select("article_id", F.explode(T.title_tokens(F.col("title"))).alias("token"))
    return L.prefix_search(a, ["th", "er", "th"])


@query(_A + "SELECT article_id, title FROM article WHERE contains(lower(title), lower('Tion Th'))")
def search_substring(spark, d):
    """case-insensitive substring of the title."""
    return D.article(spark, d).where(L.contains_text(F.col("title"), "Tion Th")).select("article_id", "title")


@query(_A + ", last AS (SELECT year, created_s, article_id FROM article ORDER BY year DESC, created_s ASC, article_id ASC LIMIT 1 OFFSET 24)\nSELECT a.article_id, a.year, a.created_s FROM article a, last l WHERE a.year < l.year OR (a.year = l.year AND (a.created_s > l.created_s OR (a.created_s = l.created_s AND a.article_id > l.article_id))) ORDER BY a.year DESC, a.created_s, a.article_id LIMIT 26")
def page_keyset(spark, d):
    """the second page of 25 by a cursor, with one row more. The client has the first page's rows and sends the
    cursor of the last one back; here the page of 25 rows is fetched to make it."""
    a = D.article(spark, d).select("article_id", "year", "created_s")
    order = [("year", "desc"), ("created_s", "asc"), ("article_id", "asc")]
    row = L.page(a, order, 24).orderBy(F.desc("year"), "created_s", "article_id").collect()[24]
    cursor = L.encode_cursor(contract="articles", values=[row["year"], row["created_s"], row["article_id"]])
    return L.page(a, order, 25, L.decode_cursor(cursor, contract="articles"))


@query(_A + "SELECT article_id, year FROM article ORDER BY year, article_id DESC LIMIT 20 OFFSET 40")
def page_offset(spark, d):
    """Offset page with explicit null placement."""
    return D.article(spark, d).select("article_id", "year").orderBy(F.asc_nulls_last("year"), F.desc_nulls_last("article_id")).offset(40).limit(20)


@query(_A + "SELECT has_human IS NOT DISTINCT FROM (has_llm AND NOT has_llm IS NULL) AS same, count(*) AS n FROM article GROUP BY 1")
def filter_null_safe(spark, d):
    """null-safe comparison."""
    return D.article(spark, d).groupBy(F.col("has_human").eqNullSafe(F.col("has_llm")).alias("same")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * EXCLUDE (text), left(text, 200) AS summary FROM documents")
def project_exclude_truncate(spark, d):
    """All columns but one, and a truncated text."""
    return D.table(spark, d, "documents").withColumn("summary", F.left("text", F.lit(200))).drop("text")


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'enum' WHEN 1 THEN 'numeric' WHEN 2 THEN 'open' WHEN 3 THEN 'numeric' WHEN 4 THEN 'enum' ELSE 'open' END AS strategy, CASE doc_id % 6 WHEN 0 THEN 'yes,no' WHEN 4 THEN source || ',' || coalesce(lang, '?') ELSE '' END AS options FROM documents""")
def filter_strategies(spark, d):
    """how answers of a type are filtered."""
    i = F.col("doc_id") % 6
    kind = F.when(i == 0, "'yes' | 'no'").when(i == 1, " Number ").when(i == 2, "string[]").when(i == 3, "number.integer | null").when(i == 4, F.concat(F.lit("'"), "source", F.lit("' | \""), F.coalesce("lang", F.lit("?")), F.lit('"')))
    return D.table(spark, d, "documents").select("doc_id", A.strategy_of(kind).alias("strategy"), F.array_join(A.options_of(kind), ",").alias("options"))


@query(D.with_(D.JUDGMENT) + "SELECT answer, count(*) AS n, count(*) FILTER (answer_list IS NOT NULL) AS listed FROM judgment WHERE answer IS NULL OR trim(answer) = '' OR answer NOT IN ('Yes', 'no') GROUP BY 1")
def audit_unexpected_answers(spark, d):
    """answers that are blank or outside the enum."""
    j = D.judgment(spark, d)
    return j.where(A.unexpected(F.array("answer"), ["Yes", "no"])).groupBy("answer").agg(F.count(F.lit(1)).alias("n"), F.count("answer_list").alias("listed"))


@query(D.with_(D.JUDGMENT) + ", x AS (SELECT judgment_id, coalesce(answer_list, CASE WHEN answer_json IS NOT NULL THEN [answer, 'yes'] END) AS l, answer FROM judgment)\nSELECT count(*) AS invalid FROM x WHERE CASE WHEN l IS NOT NULL THEN len(list_filter(l, lambda v: v NOT IN ('Yes', 'no', 'yes', 'maybe'))) > 0 ELSE answer NOT IN ('Yes', 'no', 'yes', 'maybe') END")
def audit_invalid_judgments(spark, d):
    """judgments with a member outside the enum, JSON-text arrays included."""
    options = ["Yes", "no", "yes", "maybe"]
    lst = F.coalesce(F.col("answer_list"), A.json_strings(F.col("answer_json")), F.array("answer"))
    return D.judgment(spark, d).where(A.unexpected(lst, options)).agg(F.count(F.lit(1)).alias("invalid"))


@query(D.with_(D.PROMPT, D.JUDGMENT) + "SELECT prompt_id, NOT EXISTS (SELECT 1 FROM judgment j WHERE j.prompt_id = p.prompt_id) AS no_judgments FROM prompt p WHERE NOT EXISTS (SELECT 1 FROM judgment j WHERE j.prompt_id = p.prompt_id) OR NOT enabled")
def audit_orphan_prompts(spark, d):
    """Prompts without judgments, or not enabled."""
    p = D.prompt(spark)
    used = D.judgment(spark, d).select("prompt_id").distinct().withColumn("used", F.lit(True))
    x = p.join(used, "prompt_id", "left").withColumn("no_judgments", F.col("used").isNull())
    return x.where(F.col("no_judgments") | ~F.col("enabled")).select("prompt_id", "no_judgments")


@query(_A + "SELECT article_id, CASE WHEN article_id = 77 THEN 0 ELSE 1 END AS rank FROM article WHERE article_id = 77 OR contains(lower(title), '77') ORDER BY 2, title, 1 LIMIT 50")
def search_ranked_lookup(spark, d):
    """exact id first, then titles."""
    return L.ranked_lookup(D.article(spark, d), "77").select("article_id", "rank")
