"""Queries of scalar functions, with the semantics that differ between engines made explicit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from . import domain as D


def _sha(words):
    """Digest of a list of words, as whole texts make long rows."""
    return F.sha2(F.array_join(words, " "), 256)


@query("SELECT doc_id, coalesce(nullif(source, 'src1'), 'none') AS route, CASE WHEN n_chars > 2000 THEN 'long' WHEN n_chars > 500 THEN 'mid' ELSE 'short' END AS size, greatest(n_chars, NULL, 700) AS hi, least(n_chars, NULL, 700) AS lo FROM documents")
def scalar_conditional(spark, d):
    """COALESCE, NULLIF, CASE, GREATEST and LEAST (which skip nulls)."""
    c = F.col("n_chars")
    return D.table(spark, d, "documents").select(
        "doc_id", F.coalesce(F.nullif("source", F.lit("src1")), F.lit("none")).alias("route"), F.when(c > 2000, "long").when(c > 500, "mid").otherwise("short").alias("size"),
        F.greatest(c, F.lit(None).cast("long"), F.lit(700).cast("long")).alias("hi"), F.least(c, F.lit(None).cast("long"), F.lit(700).cast("long")).alias("lo"),
    )


@query("SELECT event_id, round(value)::BIGINT AS rounded, TRY_CAST(event_type AS BIGINT) AS number, (user_id::VARCHAR || '-' || event_id)::VARCHAR AS key, TRY_CAST(substr(props, 7, 2) AS BIGINT) AS k FROM events")
def scalar_casts(spark, d):
    """Casts: floats are rounded before becoming integers; TRY_CAST gives null."""
    e = D.table(spark, d, "events")
    return e.select("event_id", F.round("value").cast("long").alias("rounded"), F.col("event_type").try_cast("long").alias("number"), F.concat_ws("-", F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("key"), F.substring("props", 7, 2).try_cast("long").alias("k"))


@query("""SELECT p_partkey, lower(p_name) AS low, trim('  ' || p_brand || ' ') AS trimmed, length(p_name) AS n, left(p_name, 3) AS head, replace(p_name, ' ', '_') AS under, regexp_replace(p_name, '[aeiou]', '#', 'g') AS masked, regexp_matches(p_name, 'r.n') AS found,
split_part(p_name, ' ', 2) AS second, starts_with(p_brand, 'Brand#1') AS first_brand, contains(p_name, 'ring') AS ring, p_name LIKE '%e%g' AS liked, concat(p_brand, NULL, p_type) AS joined, array_to_string(string_split(p_name, ' '), '|') AS parts, chr(65 + (p_partkey % 26)::INTEGER) AS letter, sha256(p_name) AS digest FROM part""")
def scalar_strings(spark, d):
    """String functions; SQL trim takes spaces only, concat skips nulls, replacement is global."""
    c = F.col
    return D.table(spark, d, "part").select(
        "p_partkey", F.lower("p_name").alias("low"), F.trim(F.concat(F.lit("  "), c("p_brand"), F.lit(" "))).alias("trimmed"), F.length("p_name").cast("long").alias("n"), F.left("p_name", F.lit(3)).alias("head"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("under"), F.regexp_replace("p_name", "[aeiou]", "#").alias("masked"), c("p_name").rlike("r.n").alias("found"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("second"),
        c("p_brand").startswith("Brand#1").alias("first_brand"), c("p_name").contains("ring").alias("ring"), c("p_name").like("%e%g").alias("liked"), F.concat_ws("", "p_brand", F.lit(None).cast("string"), "p_type").alias("joined"),
        F.array_join(F.split("p_name", " "), "|").alias("parts"), F.char(65 + c("p_partkey") % 26).alias("letter"), F.sha2("p_name", 256).alias("digest"),
    )


@query("""WITH a AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
SELECT doc_id, len(w) AS n, list_contains(w, 'the') AS has_the, list_has_any(w, ['of', 'and']) AS any_of, sha256(array_to_string(list_sort(list_distinct(list_filter(w, lambda x: length(x) > 2))), ' ')) AS long_words, sha256(array_to_string(list_transform(w, lambda x: lower(x)), ' ')) AS quiet, sha256(array_to_string(list_concat(w, ['end']), ' ')) AS closed FROM a""")
def scalar_arrays(spark, d):
    """Array functions and lambdas."""
    a = D.table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("w"))
    return a.select(
        "doc_id", F.size("w").cast("long").alias("n"), F.array_contains("w", "the").alias("has_the"), F.arrays_overlap("w", F.array(F.lit("of"), F.lit("and"))).alias("any_of"),
        _sha(F.array_sort(F.array_distinct(F.filter("w", lambda x: F.length(x) > 2)))).alias("long_words"), _sha(F.transform("w", lambda x: F.lower(x))).alias("quiet"), _sha(F.concat("w", F.array(F.lit("end")))).alias("closed"),
    )


@query("SELECT doc_id, u.w AS word, u.i AS ordinality FROM documents, unnest(string_split(text, ' ')) WITH ORDINALITY AS u(w, i)")
def scalar_unnest_ordinality(spark, d):
    """UNNEST WITH ORDINALITY counts from 1, posexplode from 0."""
    a = D.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "word"))
    return a.select("doc_id", "word", (F.col("i") + 1).cast("long").alias("ordinality"))


def _json_type(text):
    """JSON_TYPE: the kind of the outermost value, by its variant schema."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    return F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "varchar").when(kind == "VOID", "null").otherwise(F.lower(kind))


@query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_object('id', event_id, 'kind', event_type)::VARCHAR AS made, json_array_length('[1,2,' || (event_id % 7) || ']') ::BIGINT AS n, lower(json_type(CASE event_id % 5 WHEN 0 THEN '[1]' WHEN 1 THEN props WHEN 2 THEN '"x"' WHEN 3 THEN 'true' ELSE 'null' END::JSON)) AS kind FROM events""")
def scalar_json(spark, d):
    """JSON: extraction, objects, array length."""
    i = F.col("event_id") % 5
    kinds = F.when(i == 0, "[1]").when(i == 1, F.col("props")).when(i == 2, '"x"').when(i == 3, "true").otherwise("null")
    made = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind")))
    return D.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), made.alias("made"), F.json_array_length(F.concat(F.lit("[1,2,"), (F.col("event_id") % 7).cast("string"), F.lit("]"))).cast("long").alias("n"), _json_type(kinds).alias("kind"))


@query("SELECT event_id, j.key AS key, j.value::VARCHAR AS value FROM events, json_each(props) AS j")
def scalar_json_each(spark, d):
    """JSON members as rows, through the variant type."""
    e = D.table(spark, d, "events").select("event_id", F.try_parse_json("props").alias("v"))
    e.createOrReplaceTempView("tessera_props")
    return e.sparkSession.sql("SELECT event_id, t.key, CAST(t.value AS STRING) AS value FROM tessera_props, LATERAL variant_explode(v) AS t")


@query("SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week, date_diff('day', o_orderdate, TIMESTAMP '1999-01-01') AS days_left, strftime(o_orderdate + INTERVAL 36 HOUR, '%Y-%m-%d %H') AS later FROM orders")
def scalar_dates(spark, d):
    """Dates: truncation (weeks begin on Monday), differences, intervals."""
    t = F.col("o_orderdate").cast("timestamp")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return D.table(spark, d, "orders").select("o_orderkey", day(F.date_trunc("month", t)).alias("month"), day(F.date_trunc("week", t)).alias("week"), F.date_diff(F.lit("1999-01-01").cast("date"), t.cast("date")).cast("long").alias("days_left"), F.date_format(t + F.expr("INTERVAL 36 HOUR"), "yyyy-MM-dd HH").alias("later"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def scalar_view(spark, d):
    """A view over two tables."""
    for t in ("nation", "region"):
        D.table(spark, d, t).createOrReplaceTempView(f"tessera_{t}")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW tessera_nation_region AS SELECT n_name, r_name FROM tessera_nation JOIN tessera_region ON n_regionkey = r_regionkey")
    return spark.table("tessera_nation_region")
