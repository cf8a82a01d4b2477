"""Sinks: wide CSV exports, checksummed packages, upserts."""

from __future__ import annotations

import hashlib
import json
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_cell(value: Column) -> Column:
    """RFC 4180: quoted only where a comma, quote or line end asks for it; null is empty."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def wide_export(articles: DataFrame, answers: DataFrame, prompts: list[int], columns: list[str]) -> DataFrame:
    """Articles with one answer column per chosen prompt; a missing answer is null. The pivot's values
    are given, so it takes one aggregation."""
    wide = answers.groupBy("article_id").pivot("prompt_id", prompts).agg(F.min("answer"))
    return articles.select("article_id", *columns).join(wide, "article_id", "left").select("article_id", *columns, *[F.col(str(p)).alias(f"prompt_{p}") for p in prompts])


def csv_lines(df: DataFrame) -> DataFrame:
    """(line): each row as a CSV line."""
    return df.select(F.concat_ws(",", *[csv_cell(F.col(f"`{c}`")) for c in df.columns]).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    """Distributed CSV: part files, each with a header line."""
    df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def csv_stream(df: DataFrame):
    """A single download: byte order mark, header, then lines as partitions come in; the driver holds
    one partition at a time."""
    yield b"\xef\xbb\xbf" + ",".join(df.columns).encode() + b"\r\n"
    for r in csv_lines(df).toLocalIterator():
        yield r.line.encode() + b"\r\n"


def row_digest(df: DataFrame) -> DataFrame:
    """(digest): SHA-256 of each row as canonical JSON (sorted keys, nulls kept)."""
    names = sorted(df.columns)
    return df.select(F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256).alias("digest"))


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, digest): independent of row order. Row digests are summed in two halves modulo a prime,
    which needs no sorted list of all of them in one place."""
    h = row_digest(df).select(*[F.conv(F.substring("digest", 1 + 12 * i, 12), 16, 10).cast("long").alias(f"p{i}") for i in range(5)])
    sums = h.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(F.col(f"p{i}").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias(f"s{i}") for i in range(5)])
    return sums.select("rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(5)]), 256).alias("digest"))


def export_package(tables: dict[str, DataFrame], path: str) -> dict:
    """A ZIP of NDJSON payloads (rows sorted by their text) and a manifest with their checksums, for
    packages of a size to be handed to a person. Returns the manifest."""
    manifest: dict = {"version": 1, "payloads": {}}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in sorted(tables.items()):
            digest, n = hashlib.sha256(), 0
            lines = df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("line")).orderBy("line")
            with z.open(f"{name}.ndjson", "w") as out:
                for r in lines.toLocalIterator():
                    raw = r.line.encode() + b"\n"
                    out.write(raw)
                    digest.update(raw)
                    n += 1
            manifest["payloads"][name] = {"rows": n, "sha256": digest.hexdigest()}
        z.writestr("manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


def check_package(path: str) -> list[str]:
    """Payloads whose bytes don't agree with the manifest."""
    with zipfile.ZipFile(path) as z:
        manifest = json.loads(z.read("manifest.json"))
        return [n for n, p in manifest["payloads"].items() if hashlib.sha256(z.read(f"{n}.ndjson")).hexdigest() != p["sha256"]]


def analyze_import(incoming: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """(key, outcome): new, same, or conflict with a stored row; repeated for keys the package has twice."""
    cols = sorted(incoming.columns)
    mark = lambda df: df.select(key, F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256).alias("d"))
    i = mark(incoming).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("d"))
    e = mark(existing).withColumnRenamed("d", "stored")
    return i.join(e, key, "left").select(key, F.when(F.col("n") > 1, "repeated").when(F.col("stored").isNull(), "new").when(F.col("stored") == F.col("d"), "same").otherwise("conflict").alias("outcome"))


def insert_once(target: DataFrame, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(to append, mismatches): rows whose key is new, and those that differ from the stored row."""
    rest = [c for c in rows.columns if c != key]
    stored = target.select(key, *[F.col(c).alias(f"_{c}") for c in rest])
    differ = F.lit(False)
    for c in rest:
        differ = differ | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(target.select(key), key, "left_anti"), rows.join(stored, key).where(differ).select(*rows.columns)


def export_folder(tables: dict[str, DataFrame], path: str) -> None:
    """A package of any size: a folder of NDJSON part files for each table, written where the rows lie, and
    ``manifest`` with their fingerprints."""
    for name, df in tables.items():
        df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("line")).write.text(f"{path}/{name}")
    prints = [fingerprint(df).select(F.lit(name).alias("name"), "rows", "digest") for name, df in sorted(tables.items())]
    manifest = prints[0]
    for one in prints[1:]:
        manifest = manifest.unionByName(one)
    manifest.coalesce(1).write.json(f"{path}/manifest")


def read_payload(spark: SparkSession, path: str, name: str, schema) -> DataFrame:
    """A table of a package, or ValueError if its rows don't agree with the manifest."""
    df = spark.read.schema(schema).json(f"{path}/{name}")
    said = spark.read.schema("name string, rows long, digest string").json(f"{path}/manifest").where(F.col("name") == name)
    if said.join(fingerprint(df), ["rows", "digest"]).isEmpty():
        raise ValueError(f"payload {name} doesn't agree with the manifest")
    return df
