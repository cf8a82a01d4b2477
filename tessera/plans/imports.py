"""Queries that write rows out in a source's format, read them back and return what came in."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..registry import query
from ..sources import files, sinks
from . import domain as D
from .streams import folder


def _one_file_a_row(df, path: str) -> str:
    df.write.option("maxRecordsPerFile", 1).text(path)
    return path


def _supplier_files(spark, d) -> str:
    s = D.table(spark, d, "supplier")
    part = F.floor(F.col("s_suppkey") / 50).alias("part")
    entries = s.groupBy(part).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name", "s_acctbal"))).alias("entries"))
    return _one_file_a_row(entries.select(F.to_json(F.struct(F.lit(2).alias("version"), "part", "entries"))), f"{folder(spark)}/supplier")


@query("SELECT 2 AS version, s_suppkey // 50 AS part, s_suppkey, s_name, s_acctbal FROM supplier")
def import_json_files(spark, d):
    """Whole JSON files, each one row of a schema."""
    f = files.json_file(spark, _supplier_files(spark, d), "version int, part long, entries array<struct<s_suppkey:long,s_name:string,s_acctbal:double>>")
    return f.select("version", "part", F.inline("entries"))


@query("SELECT s_suppkey % 50 AS row_index, s_suppkey, s_name FROM supplier")
def import_json_entries(spark, d):
    """The items of an array member, in order."""
    e = files.json_entries(spark, _supplier_files(spark, d))
    get = lambda p, t: F.try_variant_get("entry", p, t)
    return e.select(F.col("row_index").cast("long").alias("row_index"), get("$.s_suppkey", "long").alias("s_suppkey"), get("$.s_name", "string").alias("s_name"))


def _uploads(spark, d) -> str:
    """Parts as uploads of 100: JSON files and, every other one, XML."""
    c = F.col
    chunk = F.floor(c("p_partkey") / 100)
    doi = F.concat(F.lit("10.1/"), c("p_partkey").cast("string"))
    authors = F.array(F.struct(c("p_brand").alias("name")).cast("struct<name:string>"), F.struct(F.lit("B & C").alias("name")))
    item = F.struct(c("p_name").alias("Title"), doi.alias("DOI"), authors.alias("authors"), F.lit("").alias("abstract"))
    xml = F.concat(F.lit("<papers><title>"), "p_name", F.lit("</title><doi>"), doi, F.lit("</doi><author>"), "p_brand", F.lit("</author><author>B &amp; C</author></papers>"))
    rows = D.table(spark, d, "part").groupBy(chunk.alias("chunk")).agg(F.collect_list(item).alias("items"), F.collect_list(xml).alias("elements"))
    as_json = F.to_json(F.struct(F.struct(c("items").alias("papers"), F.array(F.lit(1)).alias("one")).alias("data")))
    as_xml = F.concat(F.lit("<data>"), F.array_join("elements", ""), F.lit("</data>"))
    return _one_file_a_row(rows.select(F.when(c("chunk") % 2 == 0, as_json).otherwise(as_xml)), f"{folder(spark)}/uploads")


@query("SELECT '10.1/' || p_partkey AS article_id, p_name AS title, p_brand || '; B & C' AS authors, NULL::VARCHAR AS summary FROM part")
def import_structured(spark, d):
    """Articles of JSON and XML uploads."""
    return files.structured_articles(spark, _uploads(spark, d), "/data/papers").select("article_id", "title", "authors", "summary")


@query("SELECT '/data/papers' AS pointer, '$.data.papers' AS display_path, (p_partkey // 100 % 2) AS kind, items, CASE p_partkey // 100 % 2 WHEN 0 THEN 'Title,DOI,authors,abstract' ELSE 'title,doi,author' END AS keys, count(*) AS files FROM (SELECT *, count(*) OVER (PARTITION BY p_partkey // 100) AS items FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey // 100) = 1) WHERE items > 1 GROUP BY ALL")
def import_boundaries(spark, d):
    """Where uploads' items begin, by a table function."""
    c = files.boundary_candidates(spark, _uploads(spark, d)).select("pointer", "display_path", F.col("items").cast("long").alias("items"), F.array_join("keys", ",").alias("keys"))
    kind = F.when(F.col("keys").startswith("Title"), 0).otherwise(1).cast("long")
    return c.groupBy("pointer", "display_path", kind.alias("kind"), "items", "keys").agg(F.count(F.lit(1)).alias("files"))


@query("SELECT p_partkey::VARCHAR AS part_key, p_name || ', \"' || p_brand || '\"' AS name_brand, CASE WHEN p_partkey % 3 > 0 THEN 'two' || chr(10) || 'lines' END AS notes FROM part")
def import_csv(spark, d):
    """Quoted CSV with commas, quotes, line ends and empty cells; headers in snake case."""
    c = F.col
    rows = D.table(spark, d, "part").select(c("p_partkey").alias("Part Key"), F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("Name, Brand"), F.when(c("p_partkey") % 3 > 0, F.lit("two\nlines")).alias("Notes"))
    path = f"{folder(spark)}/csv"
    sinks.write_csv(rows, path)
    return files.csv_records(spark, path)


@query("SELECT 'JOUR' AS type, p_name AS title, p_brand || '|B, C' AS authors, '10.1/' || p_partkey AS doi, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_type || '|odd' END AS keywords, CASE WHEN p_partkey % 5 = 0 THEN 'second' END AS abstract FROM part")
def import_ris(spark, d):
    """Tagged records; single fields take the first tag there is, lists all."""
    c = F.col
    line = lambda tag, v: F.concat(F.lit(f"{tag}  - "), v, F.lit("\n"))
    odd = F.when(c("p_partkey") % 2 == 1, line("KW", F.lit("odd"))).otherwise("")
    text = F.concat(line("TY", F.lit("JOUR")), line("T1", F.lit("not this")), line("TI", c("p_name")), line("AU", c("p_brand")), line("A2", F.lit("B, C")), line("DO", F.concat(F.lit("10.1/"), c("p_partkey").cast("string"))), line("KW", c("p_type")), odd, F.when(c("p_partkey") % 5 == 0, line("N2", F.lit("second"))).otherwise(""), F.lit("ER  - "))
    path = f"{folder(spark)}/ris"
    D.table(spark, d, "part").select(text).write.text(path)
    r = files.ris_records(spark, path)
    return r.select("type", "title", F.array_join("authors", "|").alias("authors"), "doi", F.array_join("keywords", "|").alias("keywords"), "abstract")


@query("""WITH t AS (SELECT DISTINCT conv_id, turn, role FROM conversations), c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT 'p' || conv_id AS patient_id, 'DocumentReference' AS resource_type, conv_id || '-' || turn || '-' || role AS resource_id, 'nöte by ' || role AS text FROM t
UNION ALL SELECT 'p' || conv_id, 'Encounter', 'e' || conv_id, NULL FROM c UNION ALL SELECT 'p' || conv_id, 'Patient', 'p' || conv_id, 'Doe' || conv_id FROM c""")
def import_health_records(spark, d):
    """Gzipped NDJSON resources; notes by patient, or by encounter."""
    t = D.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("c"), F.col("turn"), "role").distinct()
    patient, encounter = F.concat(F.lit("Patient/p"), "c"), F.concat(F.lit("Encounter/e"), "c")
    note = F.base64(F.encode(F.concat(F.lit("nöte by "), "role"), "UTF-8"))
    one = F.struct(F.lit("DocumentReference").alias("resourceType"), F.concat_ws("-", "c", F.col("turn").cast("string"), "role").alias("id"), F.when(F.col("turn") % 2 == 0, F.struct(patient.alias("reference"))).alias("subject"), F.when(F.col("turn") % 2 == 1, F.struct(F.array(F.struct(encounter.alias("reference"))).alias("encounter"))).alias("context"), F.array(F.struct(F.struct(F.translate(note, "\r\n", "").alias("data")).alias("attachment"))).alias("content"))
    c = t.select("c").distinct()
    two = F.struct(F.lit("Encounter").alias("resourceType"), F.concat(F.lit("e"), "c").alias("id"), F.struct(patient.alias("reference")).alias("subject"))
    three = F.struct(F.lit("Patient").alias("resourceType"), F.concat(F.lit("p"), "c").alias("id"), F.array(F.struct(F.concat(F.lit("Doe"), "c").alias("family"))).alias("name"))
    path = f"{folder(spark)}/bulk"
    t.select(F.to_json(one)).union(c.select(F.to_json(two))).union(c.select(F.to_json(three))).write.option("compression", "gzip").text(path)
    return files.health_records(spark, path).select("patient_id", "resource_type", "resource_id", "text")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, CASE WHEN n_nationkey < 10 THEN 'a' ELSE 'b' END || n_nationkey // 5 AS cursor FROM nation")
def import_harvest(spark, d):
    """Cursor-paged pulls from two starts, each by a task of its own; one ends at null, one where it began."""
    path = f"{folder(spark)}/pages"
    store, root = files.open_folder(path)
    store.create_dir(root)
    rows = D.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name").collect()  # 25 rows, stand-ins of five responses
    for k, following in ((0, "a1"), (1, None), (2, "b3"), (3, "b4"), (4, "b2")):
        page = {"items": [r.asDict() for r in rows if r.n_nationkey // 5 == k], "next": following}
        with store.open_output_stream(f"{root}/page-{'a' if k < 2 else 'b'}{k}.json") as f:
            f.write(json.dumps(page).encode())
    spark.dataSource.register(files.PagedSource)
    pages = spark.read.format("paged").option("starts", "a0,b2").load(path)
    return pages.select(F.inline(F.array(F.from_json("item", "n_nationkey long, n_name string"))), "cursor")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def import_sqlite(spark, d):
    """A table of an SQLite file, read in ranges of row ids."""
    import sqlite3
    from contextlib import closing

    store, root = files.open_folder(folder(spark))
    store.create_dir(root)
    with closing(sqlite3.connect(f"{root}/outbox.db")) as con:
        con.execute("CREATE TABLE outbox (n_nationkey INTEGER, n_name TEXT)")
        con.executemany("INSERT INTO outbox VALUES (?, ?)", [(int(r[0]), r[1]) for r in D.table(spark, d, "nation").select("n_nationkey", "n_name").collect()])  # 25 rows
        con.commit()
    spark.dataSource.register(files.SqliteSource)
    return spark.read.format("sqlite").schema("n_nationkey long, n_name string").option("table", "outbox").load(f"{root}/outbox.db")


@query("SELECT s_suppkey, s_name, s_acctbal, CASE WHEN s_suppkey % 3 = 0 THEN 'imported' ELSE 'stored' END AS origin FROM supplier")
def import_package_roundtrip(spark, d):
    """Export a package with its manifest, check it, and commit the rows that aren't stored yet."""
    s = D.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    path = f"{folder(spark)}/package"
    sinks.export_folder({"supplier": s, "nation": D.table(spark, d, "nation")}, path)
    incoming = sinks.read_payload(spark, path, "supplier", s.schema)
    stored = s.where("s_suppkey % 3 <> 0")
    add, differing = sinks.insert_once(stored, incoming, "s_suppkey")
    rows = add.withColumn("origin", F.lit("imported")).unionByName(stored.withColumn("origin", F.lit("stored")))
    return rows.unionByName(differing.withColumn("origin", F.lit("conflict")))


@query("SELECT source, sum(ceil(length(text) / 4.0))::BIGINT AS tokens, (max(n_chars) - min(n_chars))::BIGINT AS span FROM documents GROUP BY 1")
def functions_in_sql(spark, d):
    """A SQL function and a user-defined aggregate by their SQL names."""
    files.register_functions(spark)
    docs = D.table(spark, d, "documents")
    tokens = spark.sql("SELECT source, sum(tessera_tokens(text)) AS tokens FROM {docs} GROUP BY source", docs=docs)
    return tokens.join(spark.sql("SELECT source, tessera_span(n_chars) AS span FROM {docs} GROUP BY source", docs=docs), "source")
