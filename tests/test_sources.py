"""File sources and sinks on small files."""

import base64
import gzip
import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import files, sinks


def test_ndjson(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"a": 1}\n\n  \n{"a": "x,\\"y"}\nnot json\n')
    rows = sorted(files.ndjson(spark, str(tmp_path / "a.ndjson")).select("row_index", "payload_text", F.try_variant_get("payload", "$.a", "string").alias("a")).collect())
    assert [(r.row_index, r.a) for r in rows] == [(0, "1"), (1, 'x,"y'), (2, None)]


def test_json_files(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"version": 2, "entries": [{"x": 1}, "two", None]}))
    assert files.json_file(spark, str(p), "version int").first().version == 2
    assert [r.row_index for r in files.json_entries(spark, str(p)).collect()] == [0, 1, 2]


def test_csv(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text('Title,"Study ID",Authors\n"A, b","1","X ""q"", Y"\nC,2,\n')
    rows = files.csv_records(spark, str(p)).collect()
    assert rows[0].asDict() == {"title": "A, b", "study_id": "1", "authors": 'X "q", Y'} and rows[1].authors is None
    (tmp_path / "bad.csv").write_text("A,a\n1,2\n")
    with pytest.raises(ValueError, match="headers"):
        files.csv_records(spark, str(tmp_path / "bad.csv"))


def test_ris(spark, tmp_path):
    p = tmp_path / "r.ris"
    p.write_text("TY  - JOUR\nT1  - Second choice\nTI  - First\nAU  - A, B\nA2  - C\nDO  - 10.1/x\nKW  - k1\nKW  - k2\nER  - \n\nTY  - BOOK\nCT  - Only\nN2  - Words\nER  -\n")
    a, b = sorted(files.ris_records(spark, str(p)).collect(), key=lambda r: r.type, reverse=True)
    assert (a.title, a.authors, a.doi, a.keywords) == ("First", ["A, B", "C"], "10.1/x", ["k1", "k2"])
    assert (b.type, b.title, b.abstract, b.authors) == ("BOOK", "Only", "Words", [])


def test_structured(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"data": {"papers": [{"Title": "T1", "Abstract": "S", "authors": [{"name": "A"}, "B"], "DOI": "10.1/x"}, {"name": "T2"}], "one": [1]}}))
    (tmp_path / "b.xml").write_text("<data><papers><title>X1</title><year>2001</year></papers><papers><title>X2</title></papers></data>")
    found = files.boundary_candidates(spark, str(tmp_path)).collect()
    assert {(r.pointer, r["items"]) for r in found} == {("/data/papers", 2)}
    rows = files.structured_articles(spark, str(tmp_path), "/data/papers").collect()
    assert {(r.title, r.summary, r.authors, r.article_id, r.created_at) for r in rows} == {("T1", "S", "A; B", "10.1/x", None), ("T2", None, None, None, None), ("X1", None, None, None, "2001"), ("X2", None, None, None, None)}
    assert [r.title for r in files.xml_records(spark, str(tmp_path / "b.xml"), "papers").orderBy("title").collect()] == ["X1", "X2"]


def test_health_records(spark, tmp_path):
    rows = [
        {"resourceType": "Patient", "id": "p1", "name": [{"family": "Doe"}]},
        {"resourceType": "Encounter", "id": "e1", "subject": {"reference": "Patient/p1"}, "period": {"start": "2020-01-02"}},
        {"resourceType": "DocumentReference", "id": "d1", "context": {"encounter": [{"reference": "Encounter/e1"}]}, "date": "2020-01-03", "content": [{"attachment": {"data": base64.b64encode("nöte".encode()).decode()}}]},
        {"resourceType": "DiagnosticReport", "id": "r1", "encounter": {"reference": "Encounter/none"}},
    ]
    with gzip.open(tmp_path / "x.ndjson.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, rows)))
    got = files.health_records(spark, str(tmp_path))
    assert {(r.patient_id, r.resource_id, r.text) for r in got.collect()} == {("p1", "p1", "Doe"), ("p1", "e1", None), ("p1", "d1", "nöte")}
    md = files.patient_timelines(got).first().markdown
    assert md == "# Patient p1\n\n### DocumentReference\n- 2020-01-03 d1: nöte\n\n### Encounter\n- 2020-01-02 e1"


def test_paged_source(spark, tmp_path):
    for name, nxt, items in (("start", "c2", [1, 2]), ("c2", "c3", [3]), ("c3", "start", [4])):
        (tmp_path / f"page-{name}.json").write_text(json.dumps({"items": items, "next": nxt}))
    spark.dataSource.register(files.PagedSource)
    assert sorted(r["item"] for r in spark.read.format("paged").load(str(tmp_path)).collect()) == ["1", "2", "3", "4"]


def test_paged_stream_ends_at_a_loop(spark, tmp_path):
    """Every page comes, none more than a few times, and the offset stays small."""
    for k in range(40):
        (tmp_path / f"page-c{k}.json").write_text(json.dumps({"items": [k], "next": f"c{k + 1}" if k < 39 else "c5"}))
    stream = files._PagedStream(str(tmp_path), "c0")
    at, got = stream.initialOffset(), []
    for _ in range(200):
        rows, after = stream.read(at)
        if after == at:
            break
        rows = [r[1] for r in rows]
        assert [r[1] for r in stream.readBetweenOffsets(at, after)] == rows
        got, at = got + rows, after
    assert at["cursor"] is None and set(got) == {str(k) for k in range(40)} and len(got) < 150 and len(json.dumps(at)) < 80


def test_sqlite(spark, tmp_path):
    import sqlite3

    con = sqlite3.connect(tmp_path / "a.db")
    con.execute('CREATE TABLE "out box" (id INTEGER, v TEXT)')
    con.executemany('INSERT INTO "out box" VALUES (?, ?)', [(i, None if i % 7 == 0 else f"v{i}") for i in range(50)])
    con.execute('CREATE TABLE "none" (id INTEGER)')
    con.commit()
    con.close()
    spark.dataSource.register(files.SqliteSource)
    df = spark.read.format("sqlite").schema("id long, v string").option("table", "out box").load(str(tmp_path / "a.db"))
    assert df.rdd.getNumPartitions() == 4 and {(r.id, r.v) for r in df.collect()} == {(i, None if i % 7 == 0 else f"v{i}") for i in range(50)}
    assert spark.read.format("sqlite").schema("id long").option("table", "none").load(str(tmp_path / "a.db")).count() == 0


def test_package_folder(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "x")], "id long, v string")
    sinks.export_folder({"rows": df}, str(tmp_path / "p"))
    assert sorted(sinks.read_payload(spark, str(tmp_path / "p"), "rows", df.schema).collect()) == sorted(df.collect())
    with open(next((tmp_path / "p/rows").glob("part-*")), "a") as f:
        f.write('{"id":3}\n')
    for crc in (tmp_path / "p/rows").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="manifest"):
        sinks.read_payload(spark, str(tmp_path / "p"), "rows", df.schema)


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', None), (2, "plain", "l\n2")], "id long, a string, b string").coalesce(1)
    text = b"".join(sinks.csv_stream(df)).decode("utf-8-sig")
    assert text == 'id,a,b\r\n1,"a ""q"", b",\r\n2,plain,"l\n2"\r\n'
    sinks.write_csv(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True, multiLine=True, escape='"').count() == 2


def test_package(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "x")], "id long, v string")
    m = sinks.export_package({"rows": df}, str(tmp_path / "p.zip"))
    assert m["payloads"]["rows"]["rows"] == 2 and sinks.check_package(str(tmp_path / "p.zip")) == []
    assert m == sinks.export_package({"rows": df.orderBy("id")}, str(tmp_path / "q.zip"))
    a, b = sinks.fingerprint(df).first(), sinks.fingerprint(df.orderBy("id").repartition(3)).first()
    assert a == b != sinks.fingerprint(df.limit(1)).first()
