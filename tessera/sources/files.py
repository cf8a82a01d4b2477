"""File sources: NDJSON lines, whole JSON files, structured uploads, RIS, CSV, health records, pages."""

from __future__ import annotations

import json
import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..operators.rows import indexed


def ndjson(spark: SparkSession, path: str) -> DataFrame:
    """(row_index, payload_text, payload): non-blank lines in file order, parsed to variants.

    Lines keep their place through file path and offset within a partition: each file is numbered by
    the order of its splits, so the index is the line's rank in the file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("payload_text"))
    kept = lines.where(F.trim("payload_text") != "")
    kept = kept.withColumn("at", F.col("at").cast("long"))
    return indexed(kept.select("at", "payload_text"), ["at"]).select("row_index", "payload_text", F.try_parse_json("payload_text").alias("payload"))


def json_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole file as one row of ``schema``."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("v")).select("v.*")


def json_entries(spark: SparkSession, path: str, member: str = "entries") -> DataFrame:
    """(row_index, entry): items of an array member of a whole JSON file."""
    rows = json_file(spark, path, f"{member} array<variant>")
    return rows.select(F.posexplode(member).alias("row_index", "entry"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Quoted CSV with headers in snake case; empty or repeated headers are an error."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    heads = spark.read.csv(path, header=False, multiLine=True, escape='"').first()  # Spark makes repeated headers distinct
    names = [re.sub(r"[^a-z0-9]+", "_", (c or "").strip().lower()).strip("_") for c in heads or ()]
    if not all(names) or len(set(names)) != len(names):
        raise ValueError(f"headers must be there once each: {list(heads or ())}")
    return df.toDF(*names)


#: RIS tags by field, in order of preference.
RIS_TAGS = {"title": ["TI", "T1", "CT"], "abstract": ["AB", "N2"], "authors": ["AU", "A1", "A2", "A3", "A4"], "doi": ["DO"], "pmid": ["PMID", "AN"], "urls": ["UR", "L1", "L2", "L3", "L4"], "notes": ["N1"], "keywords": ["KW"], "year": ["PY", "Y1"]}


def ris_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a tagged reference file: single fields take the first tag, lists take all.

    Files are cut at record ends by the text source, so one file is read by many tasks."""
    raw = spark.read.text(path, lineSep="\nER  -").select(F.col("value").alias("record")).where(F.col("record").rlike(r"(?m)^TY  - "))
    tags = lambda names: "|".join(names)

    def values(names: list[str]):
        found = F.regexp_extract_all("record", F.lit(rf"(?m)^(?:{tags(names)})\s{{1,4}}- ?(.*)$"), F.lit(1))
        return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")

    first = lambda names: F.coalesce(*[F.try_element_at(values([n]), F.lit(1)) for n in names])
    many = ("authors", "urls", "notes", "keywords")
    return raw.select(F.regexp_extract("record", r"(?m)^TY  - *(.*)$", 1).alias("type"), *[(values(v) if k in many else first(v)).alias(k) for k, v in RIS_TAGS.items()])


def xml_records(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def pointer_get(value, pointer: str):
    """The value at a JSON pointer."""
    for part in [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]:
        value = value[int(part)] if isinstance(value, list) else value[part]
    return value


def _xml_value(e: ET.Element):
    if not len(e) and not e.attrib:
        return (e.text or "").strip()
    out: dict = {f"@{k}": v for k, v in e.attrib.items()}
    for c in e:
        v = _xml_value(c)
        if c.tag in out:
            out[c.tag] = out[c.tag] + [v] if isinstance(out[c.tag], list) else [out[c.tag], v]
        else:
            out[c.tag] = v
    return out


def parse_structured(text: str, name: str = ""):
    """JSON or XML by file extension, else by the first character that isn't white space."""
    kind = os.path.splitext(name)[1].lower()
    if kind == ".xml" or (kind != ".json" and text.lstrip()[:1] == "<"):
        root = ET.fromstring(text)
        return {root.tag: _xml_value(root)}
    return json.loads(text)


def boundaries(value, pointer: str = "", path: str = "$") -> Iterator[tuple[str, str, int, list[str]]]:
    """(pointer, display path, items, first keys) of every array of two or more items; arrays are not entered."""
    if isinstance(value, list):
        if len(value) > 1:
            keys = list(value[0])[:8] if isinstance(value[0], dict) else []
            yield pointer, path, len(value), keys
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from boundaries(v, f"{pointer}/{k.replace('~', '~0').replace('/', '~1')}", f"{path}.{k}")


#: Member names that hold an article's fields, in order of preference.
ARTICLE_KEYS = {"title": ("title", "name", "headline"), "summary": ("abstract", "summary", "description"), "authors": ("authors", "author", "creators"), "article_id": ("doi", "pmid", "id", "identifier"), "created_at": ("published", "date", "created_at", "year")}


def article_of(item) -> dict[str, str | None]:
    """An article's fields guessed from an item's members (case and punctuation ignored)."""
    if not isinstance(item, dict):
        return {"title": str(item), "summary": None, "authors": None, "article_id": None, "created_at": None}
    plain = {re.sub(r"[^a-z]", "", k.lower()): v for k, v in item.items()}

    def text(v) -> str | None:
        if v in (None, "", [], {}):
            return None
        if isinstance(v, list):
            return "; ".join(t for t in map(text, v) if t)
        if isinstance(v, dict):
            return text(v.get("name")) or " ".join(t for t in map(text, v.values()) if t)
        return str(v)

    pick = lambda names: next((t for n in names if (t := text(plain.get(re.sub(r"[^a-z]", "", n))))), None)
    return {k: pick(names) for k, names in ARTICLE_KEYS.items()}


def structured_articles(spark: SparkSession, path: str, pointer: str) -> DataFrame:
    """Articles of the array at ``pointer`` in uploaded files; a task reads its files one after the other."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text, name in zip(b["value"], b["file"], strict=True):
                found = pointer_get(parse_structured(text, name), pointer)
                rows = [article_of(x) for x in (found if isinstance(found, list) else [found])]
                yield pd.DataFrame({"file": name, "row_index": range(len(rows)), **{k: [r[k] for r in rows] for k in ARTICLE_KEYS}})

    fields = ", ".join(f"{k} string" for k in ARTICLE_KEYS)
    return _whole_files(spark, path).mapInPandas(read, f"file string, row_index int, {fields}")


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))


class Boundaries:
    """Table function: the arrays that an upload's text could be read from, each pointer once."""

    def eval(self, text: str, name: str):
        for p, d, n, keys in {p: (p, d, n, k) for p, d, n, k in boundaries(parse_structured(text, name))}.values():
            yield p, d, n, keys


def register_functions(spark: SparkSession) -> None:
    """The engine's functions under SQL names: the table function ``tessera_boundaries``, the SQL function
    ``tessera_tokens`` and the aggregate ``tessera_span``."""
    spark.udtf.register("tessera_boundaries", F.udtf(Boundaries, returnType="pointer string, display_path string, items int, keys array<string>"))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tessera_tokens(t STRING) RETURNS BIGINT RETURN CAST(CEIL(LENGTH(t) / 4.0D) AS BIGINT)")

    @F.pandas_udf("long")
    def span(values: pd.Series) -> int:
        own = values.dropna()
        return int(own.max() - own.min()) if len(own) else 0

    spark.udf.register("tessera_span", span)


def boundary_candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, pointer, display_path, items, keys) of all arrays that uploads could be read from."""
    register_functions(spark)
    return spark.sql("SELECT file, c.* FROM {files}, LATERAL tessera_boundaries(value, file) AS c", files=_whole_files(spark, path))


def health_records(spark: SparkSession, path: str) -> DataFrame:
    """(patient_id, resource_type, resource_id, time, text): resources of NDJSON(.gz) exports by patient.

    A resource belongs to the patient it names, else to that of the encounter it names; base64 notes
    are decoded. Those without a patient are left out."""
    v = spark.read.text(path).where(F.trim("value") != "").select(F.try_parse_json("value").alias("v")).where("v is not null")
    s = lambda p: F.try_variant_get("v", p, "string")
    ref = lambda p, kind: F.nullif(F.regexp_extract(F.coalesce(s(p), F.lit("")), rf"(?:^|/){kind}/([^/]+)$", 1), F.lit(""))
    r = v.select(
        s("$.resourceType").alias("resource_type"), s("$.id").alias("resource_id"),
        F.coalesce(ref("$.subject.reference", "Patient"), ref("$.patient.reference", "Patient"), F.when(s("$.resourceType") == "Patient", s("$.id"))).alias("own_patient"),
        F.coalesce(ref("$.encounter.reference", "Encounter"), ref("$.context.encounter[0].reference", "Encounter")).alias("encounter_id"),
        F.coalesce(s("$.date"), s("$.effectiveDateTime"), s("$.issued"), s("$.period.start")).alias("time"),
        F.coalesce(F.decode(F.unbase64(F.coalesce(s("$.content[0].attachment.data"), s("$.presentedForm[0].data"))), "UTF-8"), s("$.text"), s("$.name[0].family")).alias("text"),
    )
    enc = r.where("resource_type = 'Encounter' and own_patient is not null").select(F.col("resource_id").alias("encounter_id"), F.col("own_patient").alias("encounter_patient")).dropDuplicates(["encounter_id"])
    x = r.join(enc, "encounter_id", "left").withColumn("patient_id", F.coalesce("own_patient", "encounter_patient"))
    return x.where("patient_id is not null").select("patient_id", "resource_type", "resource_id", "time", "text")


def patient_timelines(records: DataFrame) -> DataFrame:
    """(patient_id, markdown): a document per patient, sections by type, entries by time."""
    entry = F.concat(F.lit("- "), F.coalesce("time", F.lit("undated")), F.lit(" "), F.coalesce("resource_id", F.lit("")), F.when(F.col("text").isNotNull(), F.concat(F.lit(": "), F.col("text"))).otherwise(""))
    line = records.where("resource_type <> 'Patient'").select("patient_id", "resource_type", F.struct(F.coalesce("time", F.lit("~")), F.coalesce("resource_id", F.lit("")), entry.alias("line")).alias("e"))
    section = line.groupBy("patient_id", "resource_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda s: s["line"]), "\n").alias("body"))
    doc = section.groupBy("patient_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("resource_type", "body"))), lambda s: F.concat(F.lit("### "), s["resource_type"], F.lit("\n"), s["body"])), "\n\n").alias("sections"))
    return doc.select("patient_id", F.concat(F.lit("# Patient "), "patient_id", F.lit("\n\n"), "sections").alias("markdown"))


class PagedSource(DataSource):
    """Cursor-paged harvests: ``spark.read.format("paged").load(folder)`` or ``readStream``.

    A page is a JSON file {"items": [...], "next": cursor or null}; ``page-<cursor>.json`` stands in
    for the request. Reading ends at a null or repeated cursor. The option ``starts`` names first cursors, each read
    by a task of its own (``start`` alone if not given); a stream follows the first of them."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "cursor string, item string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options["path"], self.options.get("starts", "start").split(","))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _PagedStream(self.options["path"], self.options.get("starts", "start").split(",")[0])


def open_folder(path: str):
    """(file system, folder) of a path or URI that Arrow knows (local, HDFS, S3, GCS)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def fetch_page(folder: str, cursor: str) -> tuple[list[str], str | None]:
    store, root = open_folder(folder)
    try:
        with store.open_input_stream(f"{root.rstrip('/')}/page-{cursor}.json") as f:
            page = json.loads(f.read())
    except FileNotFoundError:
        return [], None
    return [json.dumps(x) for x in page["items"]], page.get("next")


class _PagedReader(DataSourceReader):
    def __init__(self, folder: str, starts: list[str]):
        self.folder, self.starts = folder, starts

    def partitions(self):
        return [InputPartition(s) for s in self.starts]

    def read(self, partition) -> Iterator[tuple]:
        cursor, seen = partition.value, set()
        while cursor is not None and cursor not in seen:
            seen.add(cursor)
            items, following = fetch_page(self.folder, cursor)
            for x in items:
                yield cursor, x
            cursor = following


class _PagedStream(SimpleDataSourceStreamReader):
    """One page a trigger; the offset is the cursor of the page to fetch next, and where to notice a loop: the cursor
    is held against one mark, which moves up after 1, 2, 4, ... pages, so the offset stays small however long the harvest
    is; a loop is read twice over at most."""

    def __init__(self, folder: str, start: str):
        self.folder, self.start = folder, start

    def initialOffset(self) -> dict:
        return {"cursor": self.start, "mark": None, "left": 1, "length": 1}

    def read(self, start: dict):
        cursor = start["cursor"]
        if cursor is None:
            return iter(()), start
        items, following = fetch_page(self.folder, cursor)
        if not items and following is None:
            return iter(()), start
        mark, left, length = start["mark"], start["left"] - 1, start["length"]
        if following in (cursor, mark):
            following = None
        if left == 0:
            mark, left, length = cursor, 2 * length, 2 * length
        return iter([(cursor, x) for x in items]), {"cursor": following, "mark": mark, "left": left, "length": length}

    def readBetweenOffsets(self, start: dict, end: dict):
        out = []
        while start["cursor"] is not None and start != end:
            rows, after = self.read(start)
            if after == start:
                break
            out += list(rows)
            start = after
        return iter(out)


class SqliteSource(DataSource):
    """A table of an SQLite file, such as a job's outbox, that all workers reach at one path:
    ``spark.read.format("sqlite").option("table", ...).schema(...).load(path)``, in ``partitions`` ranges of row ids."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        raise ValueError("a schema must be given")

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options["path"].removeprefix("file://"), self.options["table"], schema.names, int(self.options.get("partitions", "4")))


class _SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, names: list[str], partitions: int):
        quoted = lambda n: '"' + n.replace('"', '""') + '"'
        self.path, self.table, self.columns, self.n = path, quoted(table), ", ".join(map(quoted, names)), partitions

    def _rows(self, sql: str, *values) -> Iterator[tuple]:
        import sqlite3
        from contextlib import closing

        with closing(sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)) as con:
            yield from con.execute(sql, values)

    def partitions(self):
        low, high = next(self._rows(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {self.table}"))
        width = -(-(high - low + 1) // self.n) or 1
        return [InputPartition((at, min(high, at + width - 1))) for at in range(low, max(low, high) + 1, width)]

    def read(self, partition) -> Iterator[tuple]:
        return self._rows(f"SELECT {self.columns} FROM {self.table} WHERE rowid BETWEEN ? AND ?", *partition.value)
