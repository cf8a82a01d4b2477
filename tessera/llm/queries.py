"""The opN queries: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, langid, mixing, packing, phrases, simhash, tokens, toxicity, urls, warc
from .common import documents, remainder, shared_path


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _held_out(scores: DataFrame, n: int, at: int) -> DataFrame:
    return scores.withColumn("held_out", remainder("doc_id", n) == at)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.score_texts(documents(spark, sf_dir), remainder("doc_id", 10) != 0)
    return _held_out(out, 10, 0).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.learn(docs, documents(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    return _held_out(toxicity.score(docs, model), 4, 2).select("doc_id", "held_out", "score", "predicted")


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.archive(documents(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.decontaminate(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(documents(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(documents(spark, sf_dir), tokenizer_path()))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.components(simhash.fingerprints(documents(spark, sf_dir)))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir), tokenizer_path())


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = langid.learn(docs, remainder("doc_id", 5) != 0)
    return _held_out(langid.predict(docs, net), 5, 0).select("doc_id", "held_out", "lang_pred", "score")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_versions(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_lm_scoring, op2_toxicity, op3_warc_revisits, op4_decontamination, op5_url_filter, op6_best_fit_packing, op7_simhash_near_dedup, op8_token_counts, op9_language_id, op10_document_fingerprints)
}

ORACLE: dict[str, str] = {
    "op5_url_filter": r"""
WITH u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
r(rhost, rpath, rverdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
hit AS (
  SELECT page_id, host, path, rhost || rpath AS rule, rverdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT u.page_id, u.host, u.path, hit.rule, coalesce(hit.rverdict, 'allow') AS verdict
FROM u LEFT JOIN hit ON u.page_id = hit.page_id AND hit.k = 1
""",
    "op3_warc_revisits": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, h,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * (i // 4)::INTEGER + 1, 5))::BIGINT >> (15 - 5 * (i % 4)))::BIGINT & 31)::INTEGER, 1)), '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f
""",
    "op4_decontamination": r"""
WITH words AS (SELECT true AS is_item, item_id AS id, text FROM benchmark UNION ALL SELECT false, doc_id, text FROM documents),
w AS (SELECT is_item, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM words),
win AS (SELECT id AS item_id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM w WHERE is_item AND len(w) > 0)),
spots AS (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM win) WHERE NOT is_item),
found AS (SELECT s.id, s.i, s.n, win.item_id FROM (SELECT id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM spots) s JOIN win ON s.phrase = win.phrase AND s.n = win.n),
hit AS (SELECT id, count(DISTINCT pos) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY 1),
items AS (SELECT id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT id, item_id::VARCHAR AS item FROM found) GROUP BY 1)
SELECT w.id AS doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit ON hit.id = w.id LEFT JOIN items ON items.id = w.id WHERE NOT w.is_item
""",
}
