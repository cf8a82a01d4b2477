"""Entity resolution: match plans, canonical fields, trust, adjudication imports, package merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Publication states by precedence.
STATUS_RANK = {"retracted": 5, "published": 4, "accepted": 3, "submitted": 2, "preprint": 1}


def trust_rank(source: Column) -> Column:
    """0 publisher, 1 landing page, 2 preprint, 3 reference file, 4 other."""
    s = F.lower(source)
    has = lambda *words: F.greatest(*[F.contains(s, F.lit(w)).cast("int") for w in (*words, words[0])]) == 1
    return F.when(has("publisher", "crossref"), 0).when(has("landing"), 1).when(has("arxiv", "biorxiv", "medrxiv", "preprint"), 2).when(has("ris", "csv", "reference"), 3).otherwise(4)


def row_conflicts(identifiers: DataFrame) -> DataFrame:
    """(row_id, kind, distinct_values, conflict): two accepted values of one kind on a row."""
    g = identifiers.where("status = 'accepted'").groupBy("row_id", "kind").agg(F.count_distinct("value").alias("distinct_values"))
    return g.withColumn("conflict", F.col("distinct_values") > 1)


def match_plan(groups: DataFrame) -> DataFrame:
    """Action per component from (component, forced_id, matched_id, has_identifier): force, reuse the one
    match, create, or unresolved with a reason."""
    g = groups.groupBy("component").agg(
        F.count_distinct("forced_id").alias("forced"), F.min("forced_id").alias("forced_id"), F.count_distinct("matched_id").alias("matches"), F.min("matched_id").alias("matched_id"),
        F.bool_or("has_identifier").alias("identified"), F.count(F.lit(1)).alias("candidates"),
    )
    action = F.when(F.col("forced") == 1, "force").when(F.col("forced") > 1, "unresolved").when(F.col("matches") == 1, "reuse").when(F.col("matches") > 1, "unresolved").when(F.col("identified"), "create").otherwise("unresolved")
    reason = F.when(F.col("forced") > 1, "several forced ids").when((F.col("forced") == 0) & (F.col("matches") > 1), "several matches").when((F.col("forced") == 0) & (F.col("matches") == 0) & ~F.col("identified"), "no identifiers")
    target = F.when(action == "force", F.col("forced_id")).when(action == "reuse", F.col("matched_id"))
    return g.select("component", "candidates", action.alias("action"), reason.alias("reason"), target.alias("target_id"))


def canonical_fields(candidates: DataFrame, key: str = "article_id") -> DataFrame:
    """Winner of each (article, field): manual first, then trust, completeness, age, source key, value; a
    tie in trust and completeness with another text is a warning."""
    w = Window.partitionBy(key, "field")
    order = w.orderBy(F.desc("manual"), "trust", F.desc("completeness"), "created_s", "source_key", "value")
    x = candidates.where("value is not null and value <> ''").withColumn("k", F.row_number().over(order))
    top = lambda c: F.max(F.when(F.col("k") == 1, F.col(c))).over(w)
    x = x.withColumn("rival", (F.col("k") > 1) & (F.col("trust") == top("trust")) & (F.col("completeness") == top("completeness")) & (F.col("value") != top("value")) & ~top("manual"))
    x = x.withColumn("tie_warning", F.bool_or("rival").over(w))
    return x.where("k = 1").select(key, "field", "value", "source_key", "tie_warning")


def best_status(status: Column) -> Column:
    """Aggregate: the status of highest precedence; unknown ones count least."""
    rank = F.coalesce(*[F.when(status == k, v) for k, v in STATUS_RANK.items()], F.lit(0))
    return F.max_by(status, rank)


def tiered_match(rows: DataFrame, tiers: list[DataFrame], keys: list[list[str]]) -> DataFrame:
    """(row_id, tier, target, outcome): the first tier whose key finds a target decides; more than one
    target there is ambiguous, none anywhere is unmatched.

    Each tier is a table of its keys and ``target``; all tiers are joined and ranked in one pass."""
    found = None
    for i, (t, on) in enumerate(zip(tiers, keys, strict=True)):
        hit = rows.join(t.select(*on, "target").distinct(), on).select("row_id", F.lit(i).alias("tier"), "target")
        found = hit if found is None else found.unionByName(hit)
    per = found.groupBy("row_id", "tier").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target"))
    first = per.withColumn("k", F.row_number().over(Window.partitionBy("row_id").orderBy("tier"))).where("k = 1")
    x = rows.select("row_id").distinct().join(first, "row_id", "left")
    outcome = F.when(F.col("n") == 1, "matched").when(F.col("n") > 1, "ambiguous").otherwise("unmatched")
    return x.select("row_id", F.col("tier").cast("long").alias("tier"), F.when(F.col("n") == 1, F.col("target")).alias("target"), outcome.alias("outcome"))


def import_plan(matched: DataFrame, decisions: DataFrame, state: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """What an adjudication import does with each row: apply, or skip with a reason. Rows that lead to
    one target must agree."""
    x = matched.join(decisions, "row_id").join(state, matched.target == state.article_id, "left")
    w = Window.partitionBy("target")
    agree = F.size(F.collect_set("value").over(w)) == 1
    reason = (
        F.when(F.col("outcome") != "matched", F.col("outcome")).when(~F.col("value").isin(*allowed), "invalid value").when(F.coalesce(F.col("resolved"), F.lit(False)), "already resolved")
        .when(~F.coalesce(F.col("conflicting"), F.lit(False)), "not conflicting").when(~agree, "rows disagree")
    )
    return x.select("row_id", "target", "value", F.coalesce(reason, F.lit("apply")).alias("action"))


def record_key(record_id: Column, doi: Column, pmid: Column, title: Column, year: Column, author: Column) -> Column:
    """The strongest key that a reference record has."""
    plain = F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " ")
    named = F.concat_ws("|", F.trim(plain), F.coalesce(year.cast("string"), F.lit("")), F.coalesce(F.lower(author), F.lit("")))
    return F.coalesce(F.concat(F.lit("id:"), record_id), F.concat(F.lit("doi:"), F.lower(doi)), F.concat(F.lit("pmid:"), pmid), F.concat(F.lit("hash:"), F.sha2(named, 256)))


def package_merge(all_rows: DataFrame, overlays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(canonical, missing): the first row of each key with its overlay stages, and overlay rows
    without a reference. Rows have key, file_order, row_index; overlays also stage."""
    first = all_rows.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("file_order", "row_index"))).where("k = 1").drop("k")
    stages = overlays.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("stage")), ",").alias("stages"), (F.count_distinct("role") > 1).alias("role_conflict"))
    return first.join(stages, "key", "left"), overlays.join(first.select("key"), "key", "left_anti")


def study_groups(records: DataFrame) -> DataFrame:
    """Study keys with several records: how many, and whether their decisions conflict."""
    g = records.where("study_key is not null").groupBy("study_key").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("decision").alias("decisions"))
    return g.where("records > 1").select("study_key", "records", (F.col("decisions") > 1).alias("conflict"))


def merge_prompts(links: DataFrame, keep: int, drop: list[int]) -> DataFrame:
    """Links to the dropped prompts lead to the kept one; of links that become alike the first stays."""
    moved = links.withColumn("prompt_id", F.when(F.col("prompt_id").isin(*drop), F.lit(keep)).otherwise(F.col("prompt_id")))
    w = Window.partitionBy("project_id", "prompt_id").orderBy("link_id")
    return moved.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
