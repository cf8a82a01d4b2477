"""The review domain, derived from the given tables by integer rules (the same in DuckDB below)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1_704_067_200  # 2024-01-01T00:00:00Z


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: title (its first line, whole), import route, year, creation second, list-mode flags."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        i.alias("article_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("source").alias("route"), "lang", "n_chars",
        (1990 + i % 35).alias("year"), (EPOCH + (i * 7919) % 31_536_000).alias("created_s"), (i % 3 == 0).alias("curated"),
        (i % 2 == 0).alias("has_llm"), F.when(i % 7 != 0, i % 5 < 2).alias("has_human"), (i % 11 == 0).alias("duplicate"), (i % 13 == 0).alias("conflict"),
    )


def prompt(spark: SparkSession) -> DataFrame:
    rows = [(1, 1, "Include?", "include", True), (2, 2, "Exclude?", "exclude", True), (3, None, "Combined?", "combined", True), (4, 4, "Archived?", "include", False)]
    return spark.createDataFrame(rows, "prompt_id long, prompt_order int, heading string, prompt_type string, enabled boolean")


def judgment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers: two models, three prompts; some articles have a later second generation."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    grid = spark.createDataFrame([(m, p, g) for m in (1, 2) for p in (1, 2, 3) for g in (0, 1)], "model_id long, prompt_id long, generation long")
    x = d.crossJoin(F.broadcast(grid))  # twelve fixed rows
    i, m, p, g = F.col("doc_id"), F.col("model_id"), F.col("prompt_id"), F.col("generation")
    x = x.where(((i * 7 + m * 3 + p) % 11 != 0) & ((g == 0) | (i % 5 == 0)))
    h = (i * 31 + F.col("n_chars") + m * 7 + p * 13 + g) % 10
    answer = F.when(h < 5, "Yes").when(h < 8, "no").when(h == 8, "maybe").otherwise("")
    return x.select(
        (i * 100 + m * 20 + p * 4 + g).alias("judgment_id"), i.alias("article_id"), m.alias("model_id"), p.alias("prompt_id"), g.alias("generation"),
        answer.alias("answer"),
        F.when((i + p) % 4 == 0, F.array(answer, F.lit(" no "), F.lit(""))).alias("answer_list"),
        F.when((i + p) % 4 == 1, F.concat(F.lit('["'), answer, F.lit('", 3, "yes"]'))).alias("answer_json"),
        (EPOCH + (i * 97 + m * 5 + p) % 1000 + g * 5000).alias("created_s"),
    )


def human(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human answers to the first two prompts, from the labels."""
    x = table(spark, sf_dir, "labels")
    one = x.select(F.col("doc_id").alias("article_id"), F.lit(1).cast("long").alias("prompt_id"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("answer"))
    two = x.select(F.col("doc_id").alias("article_id"), F.lit(2).cast("long").alias("prompt_id"), F.when(F.col("toxic") == 1, "no").otherwise("yes").alias("answer"))
    return one.unionByName(two)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjudicated answers to the first prompt."""
    a = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "yes").when(F.col("quality") == 0, "no").otherwise("maybe")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("article_id"), F.lit(1).cast("long").alias("prompt_id"), a.alias("answer"))


def token_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token measures from events: created second, prompt and completion tokens, requests, failures."""
    e = table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    return e.select(
        "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_s"), (F.col("user_id") % 5).alias("job_id"), cents.alias("prompt_tokens"), (cents % 97).alias("completion_tokens"),
        (cents + cents % 97).alias("total_tokens"), (1 + F.col("event_id") % 3).alias("requests"), (F.col("event_type") == "error").alias("failed"), "event_type", "user_id", "props",
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change deltas: the user is the source partition, the event id its order; some are sent twice."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    kind = F.when(F.col("event_type") == "error", "article_deleted").when(F.col("event_type") == "signup", "article_added").when(F.col("event_type") == "purchase", "llm_judged").when(F.col("event_type") == "view", "human_judged").otherwise("article_updated")
    return e.select(
        "event_id", (F.col("user_id") % 16).alias("partition_id"), (F.col("event_id") * 17 % 500).alias("article_id"), kind.alias("change_kind"),
        F.concat_ws("-", kind, (F.col("event_id") - F.col("event_id") % 2 * F.when(F.col("event_id") % 10 == 1, 1).otherwise(0)).cast("string")).alias("idempotency_key"),
        (kind == "article_deleted").alias("tombstone"),
    )


#: The same rules for DuckDB.
ARTICLE = """article AS (SELECT doc_id AS article_id, split_part(text, chr(10), 1) AS title, source AS route, lang, n_chars, 1990 + doc_id % 35 AS year,
  1704067200 + (doc_id * 7919) % 31536000 AS created_s, doc_id % 3 = 0 AS curated, doc_id % 2 = 0 AS has_llm,
  CASE WHEN doc_id % 7 <> 0 THEN doc_id % 5 < 2 END AS has_human, doc_id % 11 = 0 AS duplicate, doc_id % 13 = 0 AS conflict FROM documents)"""
PROMPT = """prompt(prompt_id, prompt_order, heading, prompt_type, enabled) AS (VALUES (1::BIGINT, 1, 'Include?', 'include', true), (2, 2, 'Exclude?', 'exclude', true),
  (3, NULL, 'Combined?', 'combined', true), (4, 4, 'Archived?', 'include', false))"""
JUDGMENT = """judgment0 AS (SELECT doc_id AS i, n_chars, m, p, g, (doc_id * 31 + n_chars + m * 7 + p * 13 + g) % 10 AS h
  FROM documents, (SELECT unnest([1, 2])::BIGINT AS m), (SELECT unnest([1, 2, 3])::BIGINT AS p), (SELECT unnest([0, 1])::BIGINT AS g)
  WHERE (doc_id * 7 + m * 3 + p) % 11 <> 0 AND (g = 0 OR doc_id % 5 = 0)),
judgment1 AS (SELECT *, CASE WHEN h < 5 THEN 'Yes' WHEN h < 8 THEN 'no' WHEN h = 8 THEN 'maybe' ELSE '' END AS answer FROM judgment0),
judgment AS (SELECT i * 100 + m * 20 + p * 4 + g AS judgment_id, i AS article_id, m AS model_id, p AS prompt_id, g AS generation, answer,
  CASE WHEN (i + p) % 4 = 0 THEN [answer, ' no ', ''] END AS answer_list, CASE WHEN (i + p) % 4 = 1 THEN '["' || answer || '", 3, "yes"]' END AS answer_json,
  1704067200 + (i * 97 + m * 5 + p) % 1000 + g * 5000 AS created_s FROM judgment1)"""
HUMAN = """human AS (SELECT doc_id AS article_id, 1::BIGINT AS prompt_id, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS answer FROM labels
  UNION ALL SELECT doc_id, 2, CASE WHEN toxic = 1 THEN 'no' ELSE 'yes' END FROM labels)"""
TRUTH = """truth AS (SELECT doc_id AS article_id, 1::BIGINT AS prompt_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'yes' WHEN quality = 0 THEN 'no' ELSE 'maybe' END AS answer FROM labels)"""
TOKEN_USE = """token_use AS (SELECT event_id, floor(epoch(ts))::BIGINT AS created_s, user_id % 5 AS job_id, round(value * 100)::BIGINT AS prompt_tokens, round(value * 100)::BIGINT % 97 AS completion_tokens,
  round(value * 100)::BIGINT + round(value * 100)::BIGINT % 97 AS total_tokens, 1 + event_id % 3 AS requests, event_type = 'error' AS failed, event_type, user_id, props FROM events)"""
LEDGER = """ledger0 AS (SELECT *, CASE event_type WHEN 'error' THEN 'article_deleted' WHEN 'signup' THEN 'article_added' WHEN 'purchase' THEN 'llm_judged' WHEN 'view' THEN 'human_judged' ELSE 'article_updated' END AS change_kind FROM events),
ledger AS (SELECT event_id, user_id % 16 AS partition_id, event_id * 17 % 500 AS article_id, change_kind,
  change_kind || '-' || (event_id - CASE WHEN event_id % 10 = 1 THEN event_id % 2 ELSE 0 END) AS idempotency_key, change_kind = 'article_deleted' AS tombstone FROM ledger0)"""
#: Cells: the latest answer of each rater, lower-cased distinct list (see functions.answers).
LATEST = """latest AS (SELECT * FROM judgment QUALIFY row_number() OVER (PARTITION BY article_id, model_id, prompt_id ORDER BY created_s DESC, judgment_id DESC) = 1)"""
CELL = """cell AS (
  SELECT article_id, 'llm:' || model_id || ':' || prompt_id AS column_id, 'llm' AS kind, model_id, prompt_id,
    CASE WHEN answer_list IS NOT NULL THEN list_filter(list_transform(answer_list, lambda x: lower(trim(x))), lambda x: x <> '')
      WHEN answer_json IS NOT NULL THEN list_filter([lower(trim(answer)), 'yes'], lambda x: x <> '')
      WHEN trim(answer) <> '' THEN [lower(trim(answer))] ELSE []::VARCHAR[] END AS raw FROM latest
  UNION ALL SELECT article_id, 'human:' || prompt_id, 'human', NULL, prompt_id, [answer] FROM human),
cells AS (SELECT article_id, column_id, kind, model_id, prompt_id,
  list_filter(raw, lambda x, k: list_position(raw, x) = k) AS answers FROM cell)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
