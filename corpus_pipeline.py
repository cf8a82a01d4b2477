"""Corpus pipeline: language ID, toxicity, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return rows of ``documents`` with all their columns; the last returns the packed pieces. ``run``
writes each stage's result to the shared folder and reads it back, so that a stage is never
computed twice and lost executors redo one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import common, langid, packing, phrases, queries, simhash, toxicity


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language (no letter, or no label above the floor)."""
    return langid.keep_known(docs, langid.learn(docs, common.remainder("doc_id", 5) != 0))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score as toxic; the labels are those of documents that are left."""
    labels = common.documents(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels, common.remainder("doc_id", 4) != 2)
    return toxicity.keep_clean(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group, that with the least doc_id.

    Rows with one doc_id in one group are repeats: one of them (least text) stays; in different groups
    they are different documents. Of rows without a doc_id one (least text) stays of each group that has no
    doc_id at all."""
    own = docs.select(F.struct(F.col("doc_id"), F.xxhash64("text").alias("h")).alias("key"), "text")
    prints = simhash.fingerprints(own, id_col="key").select(F.col("id.doc_id").alias("id"), F.col("id.h").alias("h"), "fp")
    keys = simhash.grouped(prints).where("id <=> component_id").groupBy("id", "h", "label").agg(F.count(F.lit(1)).alias("n"))
    keys = common.written(keys.withColumn("repeated", F.sum("n").over(Window.partitionBy("id", "label")) > 1), "distinct-keys")
    first = _same(docs, keys.where("not repeated"), "left_semi")
    again = keys.where("repeated")
    if again.isEmpty():
        return first
    rows = _same(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text"), again, "inner")
    order = F.struct("row.text", *[F.col(f"row.{c}").cast("string") for c in docs.columns])
    return first.unionByName(rows.groupBy("id", "label").agg(F.min_by("row", order).alias("row")).select("row.*"))


def _same(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Join rows to ``keys`` (id, h): a row is known by its doc_id, null or not, and its text's hash."""
    return docs.join(keys, docs.doc_id.eqNullSafe(keys.id) & (F.xxhash64(docs.text) == keys.h), how)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with any benchmark window."""
    found = phrases.judge(docs, common.documents(spark, sf_dir, "benchmark"))
    return _same(docs, found.where("contaminated").select("id", "h").distinct(), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sum-of-squares packing into sequences of 2048 tokens."""
    return packing.pack(packing.pieces(docs, queries.tokenizer_path()))


STAGES = [
    ("language_id", language),
    ("toxicity", clean),
    ("simhash_near_dedup", distinct),
    ("decontamination", decontaminated),
    ("best_fit_packing", packed),
]

#: No SQL for trained models, fingerprints and tokenizers; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
