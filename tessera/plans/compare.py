"""Queries of the rater comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..operators import compare as C
from ..registry import query
from . import domain as D

_CELLS = D.with_(D.JUDGMENT, D.LATEST, D.HUMAN, D.CELL)
_PAIRS = """, dec AS (SELECT *, CASE WHEN len(answers) = 1 THEN CASE WHEN answers[1] IN ('yes', 'maybe') THEN 'include' WHEN answers[1] = 'no' THEN 'exclude' END END AS d FROM cells WHERE len(answers) > 0),
pairs AS (SELECT a.article_id, a.prompt_id, a.column_id AS lc, b.column_id AS rc, a.answers AS la, b.answers AS ra, a.d AS ld, b.d AS rd
  FROM dec a JOIN dec b ON a.article_id = b.article_id AND a.prompt_id = b.prompt_id AND a.column_id < b.column_id)
"""
_COUNTS = """count(*) AS overlap_count, count(*) FILTER (WHERE NOT list_has_any(la, ra)) AS conflict_count, count(*) FILTER (WHERE ld <> rd) AS true_conflict_count,
  count(*) FILTER (WHERE ld IS NOT NULL AND rd IS NOT NULL) AS binary_pairs, count(*) FILTER (WHERE ld = rd) AS agreement_count,
  count(*) FILTER (WHERE ld = 'include' AND rd IS NOT NULL) AS left_include, count(*) FILTER (WHERE ld = 'exclude' AND rd IS NOT NULL) AS left_exclude,
  count(*) FILTER (WHERE rd = 'include' AND ld IS NOT NULL) AS right_include, count(*) FILTER (WHERE rd = 'exclude' AND ld IS NOT NULL) AS right_exclude,
  count(*) FILTER (WHERE ld = 'include' AND rd = 'include') AS both_include, count(*) FILTER (WHERE ld = 'exclude' AND rd = 'exclude') AS both_exclude"""


def cells(spark, d):
    return C.build_cells(D.judgment(spark, d), D.human(spark, d))


@query(_CELLS + "SELECT article_id, column_id, kind, prompt_id, array_to_string(answers, '\n') AS answers FROM cells")
def compare_cells(spark, d):
    """Normalised latest cells of all raters."""
    return cells(spark, d).select("article_id", "column_id", "kind", "prompt_id", F.array_join("answers", "\n").alias("answers"))


@query(_CELLS + _PAIRS + f""", g AS (SELECT prompt_id, lc AS left_column_id, rc AS right_column_id, {_COUNTS} FROM pairs GROUP BY ALL),
r AS (SELECT *, agreement_count / nullif(binary_pairs, 0)::DOUBLE AS po, (left_include / nullif(binary_pairs, 0)::DOUBLE) * (right_include / nullif(binary_pairs, 0)::DOUBLE) + (left_exclude / nullif(binary_pairs, 0)::DOUBLE) * (right_exclude / nullif(binary_pairs, 0)::DOUBLE) AS pe FROM g)
SELECT * EXCLUDE (po, pe), round(CASE WHEN pe = 1 THEN CASE WHEN po = 1 THEN 1.0 END ELSE (po - pe) / (1 - pe) END, 6) AS kappa,
  round(CASE WHEN left_column_id LIKE 'human%' THEN both_include / nullif(left_include, 0)::DOUBLE END, 6) AS sensitivity,
  round(CASE WHEN left_column_id LIKE 'human%' THEN both_exclude / nullif(left_exclude, 0)::DOUBLE END, 6) AS specificity FROM r""")
def compare_pair_stats(spark, d):
    """Agreement counts, kappa, sensitivity and specificity of every pair of raters."""
    return C.with_agreement(C.pair_counts(C.pair_up(cells(spark, d)), "prompt_id", "left_column_id", "right_column_id"))


@query(D.with_(D.ARTICLE, D.JUDGMENT, D.LATEST, D.HUMAN, D.CELL) + _PAIRS + """SELECT lc AS left_column_id, rc AS right_column_id, CASE WHEN grouping(lang) = 1 THEN 'total' ELSE coalesce(lang, '?') END AS category,
  grouping(lang)::BIGINT AS is_total, count(*) AS overlap_count, count(*) FILTER (WHERE ld = rd) AS agreement_count
FROM pairs JOIN article USING (article_id) GROUP BY GROUPING SETS ((lc, rc, lang), (lc, rc))""")
def compare_category_totals(spark, d):
    """A10: pair counts by category with totals, as grouping sets instead of a union."""
    p = C.pair_up(cells(spark, d)).join(D.article(spark, d).select("article_id", "lang"), "article_id")
    p = p.select(F.col("left_column_id"), F.col("right_column_id"), "lang", (F.col("left_decision") == F.col("right_decision")).alias("same"))
    sets = [[F.col("left_column_id"), F.col("right_column_id"), F.col("lang")], [F.col("left_column_id"), F.col("right_column_id")]]
    g = p.groupingSets(sets, "left_column_id", "right_column_id", "lang").agg(F.grouping("lang").cast("long").alias("is_total"), F.count(F.lit(1)).alias("overlap_count"), F.count_if("same").alias("agreement_count"))
    return g.select("left_column_id", "right_column_id", F.when(F.col("is_total") == 1, "total").otherwise(F.coalesce("lang", F.lit("?"))).alias("category"), "is_total", "overlap_count", "agreement_count")


_TRUTH = D.with_(D.JUDGMENT, D.LATEST, D.HUMAN, D.TRUTH, D.CELL) + """, dec AS (SELECT *, CASE WHEN len(answers) = 1 THEN CASE WHEN answers[1] IN ('yes', 'maybe') THEN 'include' WHEN answers[1] = 'no' THEN 'exclude' END END AS d FROM cells),
t AS (SELECT article_id, prompt_id, CASE WHEN answer IN ('yes', 'maybe') THEN 'include' ELSE 'exclude' END AS t FROM truth),
x AS (SELECT m.column_id, t.t, m.d AS m, h.d AS h FROM dec m JOIN t USING (article_id, prompt_id) JOIN dec h ON h.article_id = m.article_id AND h.prompt_id = m.prompt_id AND h.kind = 'human' AND h.d IS NOT NULL WHERE m.kind = 'llm' AND m.d IS NOT NULL),
g AS (SELECT column_id, count(*) AS resolved_count, count(*) FILTER (t = 'include' AND m = 'include') AS tp, count(*) FILTER (t = 'exclude' AND m = 'include') AS fp, count(*) FILTER (t = 'exclude' AND m = 'exclude') AS tn, count(*) FILTER (t = 'include' AND m = 'exclude') AS fn,
  count(*) FILTER (h = t) AS human_correct, count(*) FILTER (m = t) AS llm_correct, count(*) FILTER (h = t AND m = t) AS both_correct, count(*) FILTER (m = t AND h <> t) AS llm_only, count(*) FILTER (h = t AND m <> t) AS human_only FROM x GROUP BY 1)
"""


@query(_TRUTH + "SELECT * FROM g")
def compare_truth_counts(spark, d):
    """Decisions of models and humans against the adjudicated truth."""
    return C.truth_counts(cells(spark, d), D.truth(spark, d))


@query(_TRUTH + """SELECT *, round((tp + tn) / nullif(tp + tn + fp + fn, 0)::DOUBLE, 6) AS accuracy, round((tp / nullif(tp + fn, 0)::DOUBLE + tn / nullif(tn + fp, 0)::DOUBLE) / 2, 6) AS balanced_accuracy,
  round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1, round(tn / nullif(tn + fn, 0)::DOUBLE, 6) AS npv, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS sensitivity,
  round(tn / nullif(tn + fp, 0)::DOUBLE, 6) AS specificity, round((tp + fn) / nullif(tp + tn + fp + fn, 0)::DOUBLE, 6) AS prevalence,
  round(CASE WHEN llm_only + human_only > 0 THEN (abs(llm_only - human_only) - 1) ** 2 / (llm_only + human_only)::DOUBLE END, 6) AS mcnemar,
  CASE WHEN llm_correct > human_correct THEN 'LLM' WHEN human_correct > llm_correct THEN 'Human' ELSE 'Tie' END AS winner FROM g""")
def compare_truth_metrics(spark, d):
    """Confusion measures, McNemar's statistic, winner."""
    return C.with_truth_metrics(C.truth_counts(cells(spark, d), D.truth(spark, d)))


_FLAGS = D.with_(D.ARTICLE, D.JUDGMENT, D.LATEST, D.HUMAN, D.CELL) + _PAIRS + """, own AS (SELECT article_id, count(*) FILTER (len(answers) > 0) AS answered_columns, count(*) FILTER (kind = 'llm' AND len(answers) > 0) AS llm_answered, count(*) FILTER (kind = 'human' AND len(answers) > 0) AS human_answered,
  bool_or(len(answers) > 1) AS multiple_answers, bool_or(kind = 'llm' AND list_contains(answers, 'yes')) AS llm_yes, bool_or(kind = 'llm' AND list_contains(answers, 'no')) AS llm_no, bool_or(kind = 'llm' AND list_contains(answers, 'maybe')) AS llm_maybe,
  bool_or(kind = 'human' AND list_contains(answers, 'yes')) AS human_yes, bool_or(kind = 'human' AND list_contains(answers, 'no')) AS human_no FROM cells GROUP BY 1),
pf AS (SELECT article_id, bool_or(lc LIKE 'human%' AND rc LIKE 'llm%') AS a, bool_or(lc LIKE 'human%' AND rc LIKE 'llm%' AND list_sort(la) <> list_sort(ra)) AS b, bool_or(lc LIKE 'human%' AND rc LIKE 'llm%' AND coalesce(ld <> rd, false)) AS c,
  bool_or(lc LIKE 'llm%' AND list_sort(la) <> list_sort(ra)) AS d, bool_or(lc LIKE 'llm%' AND coalesce(ld <> rd, false)) AS e FROM pairs GROUP BY 1),
flags AS (SELECT article_id, coalesce(answered_columns, 0) AS answered_columns, coalesce(llm_answered, 0) AS llm_answered, coalesce(human_answered, 0) AS human_answered, coalesce(multiple_answers, false) AS multiple_answers, coalesce(llm_yes, false) AS llm_yes, coalesce(llm_no, false) AS llm_no, coalesce(llm_maybe, false) AS llm_maybe,
  coalesce(human_yes, false) AS human_yes, coalesce(human_no, false) AS human_no, coalesce(a, false) AS human_llm_overlap, coalesce(b, false) AS human_llm_difference, coalesce(c, false) AS human_llm_true_conflict, coalesce(d, false) AS llm_llm_difference, coalesce(e, false) AS llm_llm_true_difference,
  coalesce(b, false) OR coalesce(d, false) AS any_disagreement FROM article LEFT JOIN own USING (article_id) LEFT JOIN pf USING (article_id))
"""


@query(_FLAGS + "SELECT * FROM flags")
def compare_article_flags(spark, d):
    """Roll-up flags of every article."""
    return C.article_flags(cells(spark, d), D.article(spark, d))


@query(_FLAGS + """SELECT f AS filter_key, count(*) AS n FROM (SELECT unnest(['all', 'multiple_answers', 'llm_answered_yes', 'llm_answered_maybe', 'human_answered_no']) AS f), flags
WHERE CASE f WHEN 'all' THEN true WHEN 'multiple_answers' THEN multiple_answers WHEN 'llm_answered_yes' THEN llm_yes WHEN 'llm_answered_maybe' THEN llm_maybe ELSE human_no END GROUP BY 1""")
def compare_row_filters(spark, d):
    """how many articles each row filter passes."""
    flags = C.article_flags(cells(spark, d), D.article(spark, d))
    keys = {"all": F.lit(True), "multiple_answers": F.col("multiple_answers"), "llm_answered_yes": F.col("llm_yes"), "llm_answered_maybe": F.col("llm_maybe"), "human_answered_no": F.col("human_no")}
    passed = F.array_compact(F.array(*[F.when(v, k) for k, v in keys.items()]))
    return flags.select(F.explode(passed).alias("filter_key")).groupBy("filter_key").agg(F.count(F.lit(1)).alias("n"))


@query(_FLAGS + """, ready AS (SELECT bool_or(human_llm_overlap) AS yes FROM flags)
SELECT f AS filter_key, count(*) AS n FROM (SELECT unnest(['overlap', 'difference', 'true_conflict', 'llm_difference', 'llm_true_difference', 'any_disagreement', 'unavailable']) AS f), flags, ready
WHERE CASE f WHEN 'overlap' THEN NOT yes OR human_llm_overlap WHEN 'difference' THEN NOT yes OR human_llm_difference WHEN 'true_conflict' THEN NOT yes OR human_llm_true_conflict WHEN 'llm_difference' THEN llm_llm_difference WHEN 'llm_true_difference' THEN llm_llm_true_difference WHEN 'any_disagreement' THEN any_disagreement ELSE true END GROUP BY 1""")
def compare_difference_filters(spark, d):
    """difference filters; one that isn't available passes every row."""
    flags = C.article_flags(cells(spark, d), D.article(spark, d))
    ready = F.broadcast(flags.agg(F.bool_or("human_llm_overlap").alias("yes")))  # one row
    x = flags.crossJoin(ready)
    c = F.col
    keys = {"overlap": ~c("yes") | c("human_llm_overlap"), "difference": ~c("yes") | c("human_llm_difference"), "true_conflict": ~c("yes") | c("human_llm_true_conflict"), "llm_difference": c("llm_llm_difference"), "llm_true_difference": c("llm_llm_true_difference"), "any_disagreement": c("any_disagreement"), "unavailable": F.lit(True)}
    passed = F.array_compact(F.array(*[F.when(v, k) for k, v in keys.items()]))
    return x.select(F.explode(passed).alias("filter_key")).groupBy("filter_key").agg(F.count(F.lit(1)).alias("n"))


@query(D.with_(D.JUDGMENT, D.LATEST, D.HUMAN, D.PROMPT, D.CELL) + """, x AS (SELECT c.article_id, CASE WHEN kind = 'human' THEN 'human' ELSE 'llm:' || model_id END AS rater, c.prompt_id, prompt_type, CASE WHEN len(answers) > 0 THEN answers[1] END AS a FROM cells c JOIN prompt p ON p.prompt_id = c.prompt_id AND enabled)
SELECT article_id, rater, CASE WHEN count(DISTINCT CASE WHEN a IS NOT NULL THEN prompt_id END) = (SELECT count(*) FROM prompt WHERE enabled) THEN CASE WHEN bool_or(CASE WHEN prompt_type = 'exclude' THEN a = 'yes' ELSE a = 'no' END) THEN 'no' WHEN bool_or(a = 'maybe') THEN 'maybe' ELSE 'yes' END END AS summary FROM x GROUP BY 1, 2""")
def compare_summary_answers(spark, d):
    """One summary answer per article and rater."""
    return C.summary_answers(cells(spark, d), D.prompt(spark))


@query(D.with_(D.JUDGMENT, D.LATEST, D.PROMPT) + """SELECT article_id, count(DISTINCT l.prompt_id) FILTER (trim(answer) <> '') AS answered_prompts, CASE WHEN (SELECT count(*) FROM prompt WHERE enabled) = 0 THEN NULL WHEN count(DISTINCT l.prompt_id) FILTER (trim(answer) <> '') = (SELECT count(*) FROM prompt WHERE enabled) THEN 'answered' WHEN count(DISTINCT l.prompt_id) FILTER (trim(answer) <> '') > 0 THEN 'partial' ELSE 'unanswered' END AS status
FROM latest l JOIN prompt p ON p.prompt_id = l.prompt_id AND enabled GROUP BY 1""")
def compare_article_status(spark, d):
    """Whether all enabled prompts of an article are answered."""
    live = D.prompt(spark).where("enabled").select("prompt_id")
    j = C.latest(D.judgment(spark, d), ["article_id", "model_id", "prompt_id"], [F.desc_nulls_last("created_s"), F.desc_nulls_last("judgment_id")])
    total = F.broadcast(live.agg(F.count(F.lit(1)).alias("total")))  # one row
    g = j.join(F.broadcast(live), "prompt_id").groupBy("article_id").agg(F.count_distinct(F.when(F.trim("answer") != "", F.col("prompt_id"))).alias("answered_prompts"))
    status = F.when(F.col("total") == 0, None).when(F.col("answered_prompts") == F.col("total"), "answered").when(F.col("answered_prompts") > 0, "partial").otherwise("unanswered")
    return g.crossJoin(total).select("article_id", "answered_prompts", status.alias("status"))


@query(D.with_(D.PROMPT) + """, col AS (SELECT 'human:' || prompt_id AS column_id, 'human' AS kind, prompt_id, 0 AS o FROM prompt WHERE enabled UNION ALL SELECT 'llm:' || m || ':' || prompt_id, 'llm', prompt_id, m FROM prompt, (SELECT unnest([1, 2]) AS m) WHERE enabled UNION ALL SELECT 'truth:' || prompt_id, 'truth', prompt_id, 9 FROM prompt WHERE prompt_id = 1),
num AS (SELECT column_id, kind, prompt_id, row_number() OVER (ORDER BY o, prompt_id) AS column_order FROM col)
SELECT a.column_id AS left_column_id, b.column_id AS right_column_id, CASE WHEN b.kind = 'truth' THEN a.kind || '_vs_truth' ELSE a.kind || '_vs_' || b.kind END AS comparison_kind, a.column_order::BIGINT AS left_order FROM num a JOIN num b ON a.prompt_id = b.prompt_id AND a.column_order < b.column_order""")
def compare_column_groups(spark, d):
    """The column grid of a comparison and all its groups."""
    columns = column_grid(spark)
    groups = C.comparison_groups(columns)
    return groups.join(columns.select(F.col("column_id").alias("left_column_id"), F.col("column_order").alias("left_order")), "left_column_id").select("left_column_id", "right_column_id", "comparison_kind", "left_order")


def column_grid(spark):
    """Configuration columns: enabled prompts by rater, in order."""
    from pyspark.sql.window import Window

    live = D.prompt(spark).where("enabled").select("prompt_id")
    raters = spark.createDataFrame([("human", None, 0), ("llm", 1, 1), ("llm", 2, 2)], "kind string, model_id long, o int")
    grid = live.crossJoin(F.broadcast(raters)).unionByName(live.where("prompt_id = 1").select("prompt_id", F.lit("truth").alias("kind"), F.lit(None).cast("long").alias("model_id"), F.lit(9).alias("o")))
    name = F.concat_ws(":", "kind", "model_id", "prompt_id")
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("o", "prompt_id")).cast("long")  # a configuration of a few rows
    return grid.select(name.alias("column_id"), "kind", "model_id", "prompt_id", order.alias("column_order"))


@query(D.with_(D.ARTICLE) + "SELECT CASE WHEN lang IN ('zh', 'chi', 'zho') OR lang LIKE 'zh-%' OR regexp_matches(title, '\\p{Han}') THEN 'chinese' ELSE 'non_chinese' END AS category, count(*) AS n FROM article GROUP BY 1")
def compare_language_category(spark, d):
    """Articles by script or language category."""
    a = D.article(spark, d)
    zh = F.coalesce(F.col("lang").isin("zh", "chi", "zho") | F.col("lang").startswith("zh-"), F.lit(False)) | F.col("title").rlike(r"\p{IsHan}")
    return a.groupBy(F.when(zh, "chinese").otherwise("non_chinese").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(_CELLS + """SELECT column_id, count(*) AS cells, count(*) FILTER (len(answers) = 1 AND answers[1] IN ('yes', 'maybe')) AS included, count(*) FILTER (len(answers) = 1 AND answers[1] = 'no') AS excluded FROM cells GROUP BY 1""")
def compare_decisions(spark, d):
    """Binary decisions by column."""
    dec = A.decision(F.col("answers"))
    return cells(spark, d).groupBy("column_id").agg(F.count(F.lit(1)).alias("cells"), F.count_if(dec == "include").alias("included"), F.count_if(dec == "exclude").alias("excluded"))


@query(_CELLS + """, b AS (SELECT h.prompt_id, h.answers[1] AS ha, l.answers[1] AS la FROM cells h JOIN cells l ON h.article_id = l.article_id AND h.prompt_id = l.prompt_id AND h.kind = 'human' AND l.kind = 'llm')
SELECT prompt_id, count(*) AS both_reviewed, count(*) FILTER (ha IS DISTINCT FROM la) AS conflicts FROM b GROUP BY 1""")
def compare_conflict_counts(spark, d):
    """Pairs that a human and a model both judged, and those that differ (null-safe)."""
    c = cells(spark, d).select("article_id", "prompt_id", "kind", F.try_element_at("answers", F.lit(1)).alias("answer"))
    h = c.where("kind = 'human'").select("article_id", "prompt_id", F.col("answer").alias("ha"))
    m = c.where("kind = 'llm'").select("article_id", "prompt_id", F.col("answer").alias("la"))
    return h.join(m, ["article_id", "prompt_id"]).groupBy("prompt_id").agg(F.count(F.lit(1)).alias("both_reviewed"), F.count_if(~F.col("ha").eqNullSafe(F.col("la"))).alias("conflicts"))
