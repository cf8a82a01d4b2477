"""Queries of entity resolution and domain operators (D01-D10, D25, D27; D15-D20 are in scans)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..operators import graph, resolve
from ..operators.compare import latest
from ..registry import query
from . import domain as D

_RAW = [
    ("doi", " doi:10.1000/ABC.Def. ", "accepted", "doi", "10.1000/abc.def", None), ("doi", "https://dx.doi.org/10.1/x%20y", "rejected", None, None, "malformed"), ("doi", "10.5/q", "accepted", "doi", "10.5/q", None), ("doi", "nothing", "rejected", None, None, "malformed"), ("doi", " . ", "rejected", None, None, "empty"),
    ("pmid", "PMID: 00123", "accepted", "pmid", "123", None), ("pmid", "000", "rejected", None, None, "malformed"), ("pmid", "https://pubmed.ncbi.nlm.nih.gov/777/", "accepted", "pmid", "777", None), ("pmcid", "pmc 55", "metadata", "pmcid", "PMC55", None), ("pmcid", "66", "metadata", "pmcid", "PMC66", None),
    ("arxiv", "arXiv:2101.00001v2", "accepted", "arxiv", "2101.00001", "v2"), ("arxiv", "https://arxiv.org/pdf/2101.00001v3.pdf", "accepted", "arxiv", "2101.00001", "v3"), ("arxiv", "hep-th/9901001", "accepted", "arxiv", "hep-th/9901001", None), ("biorxiv", "https://www.biorxiv.org/content/10.1101/2020.01.01.123456v2.full.pdf", "accepted", "doi", "10.1101/2020.01.01.123456", "v2"),
    ("url", "https://www.ncbi.nlm.nih.gov/pmc/articles/PMC12/", "metadata", "pmcid", "PMC12", None), ("url", "https://doi.org/10.2/z", "accepted", "doi", "10.2/z", None), ("url", "https://example.org/10.2/z", "rejected", None, None, "unsupported-url"), ("url", None, "rejected", None, None, "empty"),
]
_SQL = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_SQL, r)) + ")" for r in _RAW) + ") t(input_kind, raw, status, kind, value, note)")
def resolve_identifiers(spark, d):
    """Identifiers in normal form, or why not."""
    x = spark.createDataFrame([r[:2] for r in _RAW], "input_kind string, raw string")
    return x.withColumn("n", I.normalize_udf("input_kind", "raw")).select("input_kind", "raw", "n.*")


_IDS = """ids AS (SELECT page_id AS row_id, 'doi' AS kind, CASE WHEN page_id % 9 = 4 THEN NULL ELSE '10.1/' || (page_id % 90) END AS value FROM pages UNION ALL SELECT page_id, 'pmid', (1 + (page_id * 7) % 120)::VARCHAR FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'doi', '10.1/' || (page_id % 88) FROM pages WHERE page_id % 5 = 0)"""


def _identifiers(spark, d):
    p = D.table(spark, d, "pages").select(F.col("page_id").alias("row_id"))
    i = F.col("row_id")
    doi = lambda n: F.concat(F.lit("https://doi.org/10.1/"), (i % n).cast("string"))
    raw = p.select("row_id", F.lit("url").alias("k"), F.when(i % 9 != 4, doi(90)).alias("raw"))
    raw = raw.unionByName(p.where(i % 3 == 0).select("row_id", F.lit("pmid").alias("k"), F.concat(F.lit("PMID:00"), (1 + (i * 7) % 120).cast("string")).alias("raw")))
    raw = raw.unionByName(p.where(i % 5 == 0).select("row_id", F.lit("url").alias("k"), doi(88).alias("raw")))
    return raw.withColumn("n", I.normalize_udf("k", "raw")).select("row_id", "n.status", "n.kind", "n.value")


@query("WITH " + _IDS + "SELECT row_id, kind, count(DISTINCT value) AS distinct_values, count(DISTINCT value) > 1 AS conflict FROM ids WHERE value IS NOT NULL GROUP BY 1, 2")
def resolve_row_conflicts(spark, d):
    """Several accepted values of one kind on a row."""
    return resolve.row_conflicts(_identifiers(spark, d))


_COMP = "WITH RECURSIVE " + _IDS + """, k AS (SELECT DISTINCT row_id AS node, kind || ':' || value AS key FROM ids WHERE value IS NOT NULL), e AS (SELECT DISTINCT a.node AS a, b.node AS b FROM k a JOIN k b USING (key)),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a), comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY 1)
"""


def _components(spark, d):
    ids = _identifiers(spark, d).where("status = 'accepted'").select(F.col("row_id").alias("node"), F.concat_ws(":", "kind", "value").alias("key"))
    return graph.components(ids)


@query(_COMP + "SELECT * FROM comp")
def resolve_components(spark, d):
    """Candidates that share identifiers, transitively."""
    return _components(spark, d)


@query(_COMP + """, g AS (SELECT component, CASE WHEN node % 31 = 0 THEN node + 1000 END AS f, CASE WHEN node % 4 = 0 THEN component * 10 + node % 2 END AS m, node % 6 <> 5 AS i FROM comp), a AS (SELECT component, count(*) AS candidates, count(DISTINCT f) AS nf, min(f) AS f, count(DISTINCT m) AS nm, min(m) AS m, bool_or(i) AS i FROM g GROUP BY 1)
SELECT component, candidates, CASE WHEN nf = 1 THEN 'force' WHEN nf > 1 THEN 'unresolved' WHEN nm = 1 THEN 'reuse' WHEN nm > 1 THEN 'unresolved' WHEN i THEN 'create' ELSE 'unresolved' END AS action, CASE WHEN nf > 1 THEN 'several forced ids' WHEN nf = 0 AND nm > 1 THEN 'several matches' WHEN nf = 0 AND nm = 0 AND NOT i THEN 'no identifiers' END AS reason, CASE WHEN nf = 1 THEN f WHEN nf = 0 AND nm = 1 THEN m END AS target_id FROM a""")
def resolve_match_plan(spark, d):
    """What happens to each group of candidates."""
    n, c = F.col("node"), F.col("component")
    g = _components(spark, d).select("component", F.when(n % 31 == 0, n + 1000).alias("forced_id"), F.when(n % 4 == 0, c * 10 + n % 2).alias("matched_id"), (n % 6 != 5).alias("has_identifier"))
    return resolve.match_plan(g)


_CAND = """cand AS (SELECT l_orderkey AS article_id, 'field' || (l_partkey % 3) AS field, 's' || l_suppkey AS source_key, (l_suppkey % 5)::INTEGER AS trust, (l_linenumber % 3)::INTEGER AS completeness, l_partkey AS created_s, l_partkey % 97 = 0 AS manual, CASE WHEN l_partkey % 10 <> 0 THEN 'v' || (l_partkey % 50) ELSE '' END AS value FROM lineitem)"""


@query("WITH " + _CAND + """, r AS (SELECT *, row_number() OVER (PARTITION BY article_id, field ORDER BY manual DESC, trust, completeness DESC, created_s, source_key, value) AS k FROM cand WHERE value <> ''),
t AS (SELECT * FROM r WHERE k = 1) SELECT t.article_id, t.field, t.value, t.source_key, bool_or(r.k > 1 AND r.trust = t.trust AND r.completeness = t.completeness AND r.value <> t.value AND NOT t.manual) AS tie_warning FROM t JOIN r ON r.article_id = t.article_id AND r.field = t.field GROUP BY 1, 2, 3, 4""")
def resolve_canonical_fields(spark, d):
    """The winning value of each field, with a warning at ties."""
    p = F.col("l_partkey")
    x = D.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("article_id"), F.concat(F.lit("field"), (p % 3).cast("string")).alias("field"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_key"), (F.col("l_suppkey") % 5).cast("int").alias("trust"),
        (F.col("l_linenumber") % 3).cast("int").alias("completeness"), p.alias("created_s"), (p % 97 == 0).alias("manual"), F.when(p % 10 != 0, F.concat(F.lit("v"), (p % 50).cast("string"))).otherwise("").alias("value"),
    )
    return resolve.canonical_fields(x)


@query("SELECT page_id, CASE WHEN page_id % 7 = 5 THEN 0 ELSE CASE page_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 2 END END AS rank FROM pages")
def resolve_trust(spark, d):
    """Source trust, the more trusted of two names in one source."""
    i = F.col("page_id")
    name = F.when(i % 6 == 0, "Crossref ").when(i % 6 == 1, "a LANDING page ").when(i % 6 == 2, "medRxiv ").when(i % 6 == 3, "refs.RIS ").when(i % 6 == 4, "by hand ").otherwise("Preprint ")
    source = F.concat(name, i.cast("string"), F.when(i % 7 == 5, " Publisher").otherwise(""))
    return D.table(spark, d, "pages").select("page_id", resolve.trust_rank(source).alias("rank"))


@query("""WITH s AS (SELECT l_orderkey AS article_id, CASE l_linenumber % 5 WHEN 0 THEN 'preprint' WHEN 1 THEN 'submitted' WHEN 2 THEN 'accepted' WHEN 3 THEN 'published' ELSE 'retracted' END AS st, CASE l_linenumber % 5 WHEN 4 THEN 5 ELSE l_linenumber % 5 + 1 END AS r FROM lineitem) SELECT article_id, arg_max(st, r) AS status FROM s GROUP BY 1""")
def resolve_status(spark, d):
    """Publication status by precedence."""
    n = F.col("l_linenumber") % 5
    st = F.when(n == 0, "preprint").when(n == 1, "submitted").when(n == 2, "accepted").when(n == 3, "published").otherwise("retracted")
    x = D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article_id"), st.alias("st"))
    return x.groupBy("article_id").agg(resolve.best_status(F.col("st")).alias("status"))


_IMPORT = """rows AS (SELECT page_id AS row_id, CASE WHEN page_id % 3 = 0 THEN page_id % 200 END AS ident, 't' || (page_id % 60) AS title FROM pages),
t0 AS (SELECT range AS ident, range AS target FROM range(0, 150)), t1 AS (SELECT DISTINCT 't' || (range % 60) AS title, range AS target FROM range(0, 80)),
f AS (SELECT row_id, 0 AS tier, target FROM rows JOIN t0 USING (ident) UNION ALL SELECT row_id, 1, target FROM rows JOIN t1 USING (title)),
p AS (SELECT row_id, tier, count(DISTINCT target) AS n, min(target) AS target FROM f GROUP BY 1, 2), b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY tier) = 1),
m AS (SELECT r.row_id, tier::BIGINT AS tier, CASE WHEN n = 1 THEN target END AS target, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS outcome FROM rows r LEFT JOIN b ON r.row_id = b.row_id)"""


def _matched(spark, d):
    i = F.col("row_id")
    rows = D.table(spark, d, "pages").select(F.col("page_id").alias("row_id")).select("row_id", F.when(i % 3 == 0, i % 200).alias("ident"), F.concat(F.lit("t"), (i % 60).cast("string")).alias("title"))
    t0 = spark.range(150).select(F.col("id").alias("ident"), F.col("id").alias("target"))
    t1 = spark.range(80).select(F.concat(F.lit("t"), (F.col("id") % 60).cast("string")).alias("title"), F.col("id").alias("target"))
    return resolve.tiered_match(rows, [t0, t1], [["ident"], ["title"]])


@query("WITH " + _IMPORT + " SELECT * FROM m")
def resolve_tiered_match(spark, d):
    """The strongest tier that finds a target decides."""
    return _matched(spark, d)


@query("WITH " + _IMPORT + """, x AS (SELECT m.*, CASE row_id % 5 WHEN 0 THEN 'no' WHEN 1 THEN 'what' ELSE 'yes' END AS value, coalesce(target % 7 = 0, false) AS resolved, coalesce(target % 2 = 1 OR target % 7 = 0, false) AS conflicting FROM m), y AS (SELECT *, count(DISTINCT value) OVER (PARTITION BY target) = 1 AS agree FROM x)
SELECT row_id, target, value, CASE WHEN outcome <> 'matched' THEN outcome WHEN value NOT IN ('yes', 'no', 'maybe') THEN 'invalid value' WHEN resolved THEN 'already resolved' WHEN NOT conflicting THEN 'not conflicting' WHEN NOT agree THEN 'rows disagree' ELSE 'apply' END AS action FROM y""")
def resolve_import_plan(spark, d):
    """What an adjudication import does with each row."""
    m = _matched(spark, d)
    i, a = F.col("row_id"), F.col("article_id")
    values = m.select("row_id", F.when(i % 5 == 0, "no").when(i % 5 == 1, "what").otherwise("yes").alias("value"))
    state = spark.range(200).select(F.col("id").alias("article_id")).select("article_id", (a % 7 == 0).alias("resolved"), ((a % 2 == 1) | (a % 7 == 0)).alias("conflicting"))
    return resolve.import_plan(m, values, state, ("yes", "no", "maybe"))


@query("""WITH r AS (SELECT doc_id, 'k' || (doc_id % 300) AS key, doc_id % 3 AS file_order, doc_id AS row_index FROM documents), f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY file_order, row_index) = 1),
o AS (SELECT 'k' || (page_id % 340) AS key, CASE page_id % 2 WHEN 0 THEN 'full_text' ELSE 'screening' END AS stage, page_id % 4 AS role FROM pages), s AS (SELECT key, string_agg(DISTINCT stage, ',' ORDER BY stage) AS stages, count(DISTINCT role) > 1 AS role_conflict FROM o GROUP BY 1)
SELECT doc_id, key, stages, role_conflict FROM f LEFT JOIN s USING (key) UNION ALL SELECT NULL, key, 'missing', NULL FROM o WHERE key NOT IN (SELECT key FROM f)""")
def resolve_package_merge(spark, d):
    """Overlays attach to the first row of their key, or are reported missing."""
    i, p = F.col("doc_id"), F.col("page_id")
    rows = D.table(spark, d, "documents").select("doc_id", F.concat(F.lit("k"), (i % 300).cast("string")).alias("key"), (i % 3).alias("file_order"), i.alias("row_index"))
    over = D.table(spark, d, "pages").select(F.concat(F.lit("k"), (p % 340).cast("string")).alias("key"), F.when(p % 2 == 0, "full_text").otherwise("screening").alias("stage"), (p % 4).alias("role"))
    first, missing = resolve.package_merge(rows, over)
    return first.select("doc_id", "key", "stages", "role_conflict").unionByName(missing.select(F.lit(None).cast("long").alias("doc_id"), "key", F.lit("missing").alias("stages"), F.lit(None).cast("boolean").alias("role_conflict")))


@query("SELECT 'k' || (doc_id % 150) AS study_key, count(*) AS records, count(DISTINCT quality) > 1 AS conflict FROM labels WHERE doc_id % 150 <> 7 GROUP BY 1 HAVING count(*) > 1")
def resolve_study_groups(spark, d):
    """Records that share a study."""
    x = D.table(spark, d, "labels").select(F.when(F.col("doc_id") % 150 != 7, F.concat(F.lit("k"), (F.col("doc_id") % 150).cast("string"))).alias("study_key"), F.col("quality").alias("decision"))
    return resolve.study_groups(x)


@query("SELECT o_custkey AS article_id, o_orderkey AS project_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) = 1")
def resolve_first_project(spark, d):
    """The first project of each article."""
    return latest(D.table(spark, d, "orders"), ["o_custkey"], [F.asc("o_orderpriority"), F.asc("o_orderkey")]).select(F.col("o_custkey").alias("article_id"), F.col("o_orderkey").alias("project_id"))


@query("WITH l AS (SELECT o_orderkey AS link_id, o_custkey % 20 AS project_id, CASE WHEN o_orderkey % 6 IN (2, 4) THEN 1 ELSE o_orderkey % 6 END AS prompt_id FROM orders) SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY project_id, prompt_id ORDER BY link_id) = 1")
def resolve_merge_prompts(spark, d):
    """Links lead to the kept prompt; repeats go."""
    x = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("link_id"), (F.col("o_custkey") % 20).alias("project_id"), (F.col("o_orderkey") % 6).alias("prompt_id"))
    return resolve.merge_prompts(x, 1, [2, 4]).select("link_id", "project_id", F.col("prompt_id").cast("long").alias("prompt_id"))
