"""Rater comparison: cells, pairs, agreement, truth, article roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import answers as A
from ..functions import metrics as M


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order (row_number, then filter)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def build_cells(judgments: DataFrame, humans: DataFrame) -> DataFrame:
    """(article_id, column_id, kind, model_id, prompt_id, answers): the latest answer of each rater.

    Judgments are dealt by article, which also serves what is later grouped by article: no second shuffle."""
    j = latest(judgments.repartition("article_id"), ["article_id", "model_id", "prompt_id"], [F.desc_nulls_last("created_s"), F.desc_nulls_last("judgment_id")])
    llm = j.select("article_id", F.concat_ws(":", F.lit("llm"), "model_id", "prompt_id").alias("column_id"), F.lit("llm").alias("kind"), "model_id", "prompt_id", A.normalized(F.col("answer_list"), F.col("answer_json"), F.col("answer")).alias("answers"))
    own = humans.select("article_id", F.concat_ws(":", F.lit("human"), "prompt_id").alias("column_id"), F.lit("human").alias("kind"), F.lit(None).cast("long").alias("model_id"), "prompt_id", F.array("answer").alias("answers"))
    return llm.unionByName(own)


def grouped_cells(cells: DataFrame) -> DataFrame:
    """(article_id, cells): an article's cells, which are those of its few columns, as one list of structs."""
    c = cells.select("article_id", F.struct("prompt_id", "column_id", "kind", "answers", A.decision(F.col("answers")).alias("decision")).alias("c"))
    return c.groupBy("article_id").agg(F.collect_list("c").alias("cells"))


def pairs_of(cells) -> Column:
    """All ordered pairs (left, right) of answered cells of one prompt in a list of :func:`grouped_cells`."""
    some = F.filter(cells, lambda c: F.size(c["answers"]) > 0)
    right = lambda a: F.filter(some, lambda b: (a["prompt_id"] == b["prompt_id"]) & (a["column_id"] < b["column_id"]))
    return F.flatten(F.transform(some, lambda a: F.transform(right(a), lambda b: F.struct(a.alias("left"), b.alias("right")))))


def pair_up(cells: DataFrame) -> DataFrame:
    """One row per article and ordered pair of answered columns of one prompt, humans to the left.

    Pairs are made within an article's list of cells: one shuffle and no join of the cells with themselves."""
    p = grouped_cells(cells).select("article_id", F.explode(pairs_of(F.col("cells"))).alias("p"))
    sides = [F.col(f"p.{side}.{x}").alias(f"{side}_{x}") for side in ("left", "right") for x in ("column_id", "answers", "decision")]
    return p.select("article_id", F.col("p.left.prompt_id").alias("prompt_id"), *sides)


def pair_counts(pairs: DataFrame, *keys: str) -> DataFrame:
    """Agreement counts of pairs by ``keys``; overlap is any shared answer, conflict none shared and
    true conflict opposite decisions."""
    both = F.col("left_decision").isNotNull() & F.col("right_decision").isNotNull()
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    li, ri = F.col("left_decision") == "include", F.col("right_decision") == "include"
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("overlap_count"),
        n(~F.arrays_overlap("left_answers", "right_answers")).alias("conflict_count"),
        n(both & (li != ri)).alias("true_conflict_count"),
        n(both).alias("binary_pairs"),
        n(both & (li == ri)).alias("agreement_count"),
        n(both & li).alias("left_include"),
        n(both & ~li).alias("left_exclude"),
        n(both & ri).alias("right_include"),
        n(both & ~ri).alias("right_exclude"),
        n(both & li & ri).alias("both_include"),
        n(both & ~li & ~ri).alias("both_exclude"),
    )


def with_agreement(counts: DataFrame) -> DataFrame:
    """Adds kappa, and (where a human is to the left) sensitivity and specificity."""
    c = F.col
    human = c("left_column_id").startswith("human")
    return counts.select(
        "*",
        F.round(M.kappa(c("binary_pairs"), c("agreement_count"), c("left_include"), c("left_exclude"), c("right_include"), c("right_exclude")), 6).alias("kappa"),
        F.round(F.when(human, M.rate(c("both_include"), c("left_include"))), 6).alias("sensitivity"),
        F.round(F.when(human, M.rate(c("both_exclude"), c("left_exclude"))), 6).alias("specificity"),
    )


def truth_counts(cells: DataFrame, truth: DataFrame, *keys: str) -> DataFrame:
    """Human and model decisions against the adjudicated truth, by model column (and ``keys``)."""
    dec = cells.select("article_id", "prompt_id", "column_id", "kind", A.decision(F.col("answers")).alias("decision")).where("decision is not null")
    t = truth.select("article_id", "prompt_id", A.decision(F.array("answer")).alias("truth")).where("truth is not null")
    h = dec.where("kind = 'human'").select("article_id", "prompt_id", F.col("decision").alias("human"))
    m = dec.where("kind = 'llm'").select("article_id", "prompt_id", "column_id", F.col("decision").alias("llm"))
    x = m.join(t, ["article_id", "prompt_id"]).join(h, ["article_id", "prompt_id"])
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    truth_in, llm_in = F.col("truth") == "include", F.col("llm") == "include"
    right_h, right_m = F.col("human") == F.col("truth"), F.col("llm") == F.col("truth")
    return x.groupBy("column_id", *keys).agg(
        F.count(F.lit(1)).alias("resolved_count"), n(truth_in & llm_in).alias("tp"), n(~truth_in & llm_in).alias("fp"), n(~truth_in & ~llm_in).alias("tn"), n(truth_in & ~llm_in).alias("fn"),
        n(right_h).alias("human_correct"), n(right_m).alias("llm_correct"), n(right_h & right_m).alias("both_correct"), n(right_m & ~right_h).alias("llm_only"), n(right_h & ~right_m).alias("human_only"),
    )


def with_truth_metrics(counts: DataFrame) -> DataFrame:
    c = F.col
    named = M.confusion(c("tp"), c("fp"), c("tn"), c("fn"))
    return counts.select(
        "*", *[F.round(v, 6).alias(k) for k, v in named.items()],
        F.round(M.mcnemar(c("llm_only"), c("human_only")), 6).alias("mcnemar"), M.winner(c("llm_correct"), c("human_correct"), "LLM", "Human").alias("winner"),
    )


def article_flags(cells: DataFrame, articles: DataFrame) -> DataFrame:
    """Roll-up flags of every article: what is answered, who agrees, who differs. Own and pair flags are read
    off an article's list of cells, so the cells are built and grouped once."""
    x = grouped_cells(cells).withColumn("pairs", pairs_of(F.col("cells")))
    has = lambda kind, word=None: F.exists("cells", lambda c: (c["kind"] == kind) & (F.array_contains(c["answers"], word)))
    n = lambda cond: F.size(F.filter("cells", lambda c: (F.size(c["answers"]) > 0) & cond(c))).cast("long")
    own_flags = {
        "answered_columns": n(lambda c: F.lit(True)), "llm_answered": n(lambda c: c["kind"] == "llm"), "human_answered": n(lambda c: c["kind"] == "human"), "multiple_answers": F.exists("cells", lambda c: F.size(c["answers"]) > 1),
        "llm_yes": has("llm", "yes"), "llm_no": has("llm", "no"), "llm_maybe": has("llm", "maybe"), "human_yes": has("human", "yes"), "human_no": has("human", "no"),
    }
    mixed = lambda p: (p["left"]["kind"] == "human") & (p["right"]["kind"] == "llm")
    models = lambda p: p["left"]["kind"] == "llm"
    text = lambda c: F.array_join(F.array_sort(c["answers"]), "|")
    differ = lambda p: text(p["left"]) != text(p["right"])
    opposite = lambda p: F.coalesce(p["left"]["decision"] != p["right"]["decision"], F.lit(False))
    some = lambda cond: F.exists("pairs", cond)
    pair_flags = {
        "human_llm_overlap": some(mixed), "human_llm_difference": some(lambda p: mixed(p) & differ(p)), "human_llm_true_conflict": some(lambda p: mixed(p) & opposite(p)),
        "llm_llm_difference": some(lambda p: models(p) & differ(p)), "llm_llm_true_difference": some(lambda p: models(p) & opposite(p)),
    }
    flags = x.select("article_id", *[F.coalesce(v, F.lit(False) if k not in ("answered_columns", "llm_answered", "human_answered") else F.lit(0)).alias(k) for k, v in (own_flags | pair_flags).items()])
    out = articles.select("article_id").join(flags, "article_id", "left")
    fill = {k: 0 for k, t in out.dtypes if t == "bigint" and k != "article_id"} | {k: False for k, t in out.dtypes if t == "boolean"}
    out = out.fillna(fill)
    return out.withColumn("any_disagreement", F.col("human_llm_difference") | F.col("llm_llm_difference"))


def summary_answers(cells: DataFrame, prompts: DataFrame) -> DataFrame:
    """One answer per article and rater over all enabled prompts: null unless each is answered; a yes
    to an exclusion or a no to an inclusion gives no, else any maybe gives maybe, else yes.

    ``prompts`` is a project's configuration, some dozens of rows, and is broadcast as such."""
    live = prompts.where("enabled")
    x = cells.withColumn("rater", F.when(F.col("kind") == "human", "human").otherwise(F.concat_ws(":", F.lit("llm"), "model_id"))).join(F.broadcast(live.select("prompt_id", "prompt_type")), "prompt_id")
    first = F.when(F.size("answers") > 0, F.col("answers")[0])
    no = F.when(F.col("prompt_type") == "exclude", first == "yes").otherwise(first == "no")
    total = F.broadcast(live.agg(F.count(F.lit(1)).alias("prompts")))  # one row
    g = x.groupBy("article_id", "rater").agg(F.count_distinct(F.when(first.isNotNull(), F.col("prompt_id"))).alias("answered"), F.bool_or(no).alias("any_no"), F.bool_or(first == "maybe").alias("any_maybe"))
    return g.crossJoin(total).select("article_id", "rater", F.when(F.col("answered") == F.col("prompts"), F.when(F.col("any_no"), "no").when(F.col("any_maybe"), "maybe").otherwise("yes")).alias("summary"))


def comparison_groups(columns: DataFrame) -> DataFrame:
    """All comparisons of a column configuration (column_id, kind, model_id, prompt_id, column_order):
    human with each model, model with model, each with the adjudication of its prompt."""
    a, b = columns.alias("a"), columns.alias("b")
    c = F.col
    kind = F.when((c("a.kind") == "human") & (c("b.kind") == "llm"), "human_vs_llm").when((c("a.kind") == "llm") & (c("b.kind") == "llm"), "llm_vs_llm").when(c("b.kind") == "truth", F.concat(c("a.kind"), F.lit("_vs_truth")))
    x = a.join(b, (c("a.prompt_id") == c("b.prompt_id")) & (c("a.column_order") < c("b.column_order")))
    return x.select(c("a.column_id").alias("left_column_id"), c("b.column_id").alias("right_column_id"), kind.alias("comparison_kind")).where("comparison_kind is not null")
