"""WARC archives with revisit records.

Headers (id, url, digest, length) alone are shuffled, by payload digest, to find which records repeat
an earlier payload. Revisit records are made of those headers; response records are written where
their payloads lie, less the rows found to be revisits, so a unique payload never moves.

Records are made and written by Spark itself: the text sink with the record end as separator writes
byte-exact ``WARC/1.1`` files to any file system that Spark reaches, and payloads never pass through
Python on the way out. Archives are bounded in bytes and read as streams, a record at a time, by their
Content-Length headers.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: RFC 4648 base32 alphabet, WARC profile, record framing and media types.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"
BLOCK_TYPE = "application/http;msgtype=response"
#: Payload bytes of an archive at most (a record beyond that has a file of its own). Records are written by
#: size classes, each ``CLASS_STEP`` times the former, so that a number of records bounds the bytes.
ARCHIVE_BYTES = 128 << 20
CLASS_BYTES = 16 << 10
CLASS_STEP = 16
#: Revisits up to this many are broadcast (id and digest, some 60 bytes each); beyond it a Bloom filter of
#: ``FILTER_BITS`` picks the rows that are joined with them.
SMALL_ROWS = 200_000
FILTER_BITS = 1 << 26


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a string or binary column, with built-in functions only."""

    def coded(hexed: Column) -> Column:
        chars = []
        for g in range(8):  # 5 hex digits are 20 bits, so 4 characters
            n = F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int")
            for shift in (15, 10, 5, 0):
                chars.append(F.substring(F.lit(BASE32), F.shiftright(n, shift).bitwiseAND(31) + 1, F.lit(1)))
        return F.concat(*chars)

    return F.transform(F.array(F.sha1(payload)), coded)[0]  # so that the digest is made once, not for each group of digits


def headers_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, payload, payload_bytes, payload_digest); null html is an empty payload."""
    payload = F.coalesce(pages[html_col], F.lit(""))
    src = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), payload.alias("payload"))
    return src.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload").cast("binary")))


def resolve_revisits(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds ``record_type``, ``refers_to`` and ``refers_url`` to rows with id, url, payload_bytes and payload_digest.

    Hand it rows without their payloads: all columns are shuffled, to meet the one row per digest that
    map-side minima leave, in a join whose other side may be split if a digest is hot. Payloads
    under ``least_bytes`` are all responses. Repeated ids with one payload: each is its own record; the
    response is every row of the least id. A null id never is a response others refer to.
    """
    named = F.when(F.col("id").isNotNull(), F.struct("id", "url"))
    original = headers.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.min(named).alias("first"), F.count(F.lit(1)).alias("copies"))
    original = original.where("copies > 1").select("payload_digest", "payload_bytes", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"))
    out = headers.join(original, ["payload_digest", "payload_bytes"], "left")
    again = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    out = out.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first_id")))
    return out.withColumn("refers_url", F.when(again, F.col("first_url"))).drop("first_id", "first_url")


def _uuid(id_col: Column, url: Column, digest: Column) -> Column:
    """A record's name: the same for wholly equal rows only (same id, url and payload)."""
    h = F.md5(F.concat_ws("\x00", F.coalesce(id_col.cast("string"), F.lit("")), F.coalesce(url, F.lit("")), digest))
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; no line for null. A header value can't hold line ends."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]", "%0A"), F.lit("\r\n")), F.lit(""))


def record_text(date: str, payload: Column | None = None) -> Column:
    """One record without its closing CRLFCRLF, with fresh headers: a response that holds ``payload``, or, without
    one, a revisit of ``refers_to``. The block is an HTTP response, of revisits its header alone."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    digest = F.col("payload_digest")
    head = [
        F.lit(f"WARC/1.1\r\nWARC-Type: {'revisit' if payload is None else 'response'}\r\n"), _line("WARC-Record-ID", _uuid(F.col("id"), F.col("url"), digest)),
        F.lit(f"WARC-Date: {date}\r\n"), _line("WARC-Target-URI", F.coalesce("url", F.lit(""))), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        _line("X-Page-ID", F.url_encode(F.col("id").cast("string"))),
    ]
    if payload is None:
        head += [
            _line("WARC-Refers-To", _uuid(F.col("refers_to"), F.col("refers_url"), digest)), _line("WARC-Refers-To-Target-URI", F.coalesce("refers_url", F.lit(""))),
            _line("X-Refers-To-Page-ID", F.url_encode(F.col("refers_to").cast("string"))), F.lit(f"WARC-Profile: {PROFILE}\r\n"),
        ]
    size = F.length(http) + (F.lit(0) if payload is None else F.col("payload_bytes"))
    return F.concat(*head, F.lit(f"Content-Type: {BLOCK_TYPE}\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"), http, *([] if payload is None else [payload]))


def without(rows: DataFrame, revisits: DataFrame) -> DataFrame:
    """The rows of ``rows`` whose (id, payload_digest) isn't one of ``revisits``, a written table.

    Few revisits are broadcast. Of many, a Bloom filter of bounded size tells which rows may be among them;
    only those are shuffled for the exact answer, the others stay where they are."""
    gone = revisits.select(F.col("id").alias("gone"), F.col("payload_digest").alias("gone_digest")).distinct()
    same = F.col("id").eqNullSafe(F.col("gone")) & (F.col("payload_digest") == F.col("gone_digest"))
    if revisits.count() <= SMALL_ROWS:
        return rows.join(F.broadcast(gone), same, "left_anti")
    bit = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "id", "payload_digest"), F.lit(FILTER_BITS))
    bits = revisits.select(F.explode(F.array(bit(1), bit(2))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS >> 6, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def may_be(a: pd.Series, b: pd.Series) -> pd.Series:
        there = [sent.value[x.to_numpy() >> 6] >> (x.to_numpy() & 63) & 1 for x in (a, b)]
        return pd.Series((there[0] & there[1]).astype(bool))

    marked = rows.withColumn("may_be", may_be(bit(1), bit(2)))
    return marked.where("not may_be").drop("may_be").unionByName(marked.where("may_be").drop("may_be").join(gone, same, "left_anti"))


def archive(pages: DataFrame, path: str, least_bytes: int = 0, compression: str = "gzip", **columns: str) -> None:
    """Write one record per row of ``pages`` under ``path``, revisits where a payload of at least
    ``least_bytes`` bytes repeats. An empty table gives an empty folder of archives.

    Wholly equal rows give records of one WARC-Record-ID; other repeated ids have their own."""
    rows = headers_of(pages, **columns)
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    heads = common.written(rows.drop("payload"), "headers")
    revisits = common.written(resolve_revisits(heads, least_bytes).where("record_type = 'revisit'"), "revisits")

    def put(df: DataFrame, text: Column, records: int) -> None:
        df.select(text.alias("value")).write.mode("append").option("lineSep", RECORD_END).option("compression", compression).option("maxRecordsPerFile", records).text(path)

    put(revisits, record_text(date), ARCHIVE_BYTES // CLASS_BYTES)
    largest = heads.agg(F.max("payload_bytes")).collect()[0][0]
    responses = without(rows, revisits)
    low, high = -1, CLASS_BYTES
    while largest is not None and low < largest:
        own = responses if high >= largest and low < 0 else responses.where((F.col("payload_bytes") > low) & (F.col("payload_bytes") <= high))
        put(own, record_text(date, F.col("payload")), max(1, ARCHIVE_BYTES // high))
        low, high = high, high * CLASS_STEP


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an archive; raises on a broken frame."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise ValueError("an archive ends within a record's headers")
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name.lower()] = value
        block = stream.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"{head.get('warc-record-id')}: the record doesn't end where it says")
        yield head, block


def read_archives(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """(id, url, record_type, payload_bytes, payload_digest, refers_to) of all records under ``path``.

    A response's digest and length are taken from its payload and must agree with its headers; a
    revisit has those of its headers (null bytes if it has none, see :func:`with_originals`)."""
    common.ship(spark)
    names = ["id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())

    def row(head: dict[str, str], block: bytes) -> tuple:
        digest, rest, size = head["warc-payload-digest"].removeprefix("sha1:"), block, None
        if head.get("content-type", "").startswith("application/http"):
            http, _, rest = block.partition(b"\r\n\r\n")
            sizes = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            size = int(sizes[0]) if sizes else None
        if head["warc-type"] == "response":
            own = base64.b32encode(hashlib.sha1(rest).digest()).decode()
            if own != digest or size not in (None, len(rest)):
                raise ValueError(f"{head['warc-record-id']}: digest {own} of {len(rest)} bytes, headers {digest} and {size}")
            size = len(rest)
        return head.get("x-page-id"), head["warc-target-uri"], head["warc-type"], size, digest, head.get("x-refers-to-page-id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell in b.column(0):
                raw = pa.BufferReader(cell.as_buffer())
                stream = gzip.GzipFile(fileobj=raw) if raw.read(2) == b"\x1f\x8b" else io.BufferedReader(raw)
                raw.seek(0)
                rows: list[tuple] = []
                for record in parse(stream):
                    rows.append(row(*record))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    out = files.mapInArrow(read, "id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string")
    return out.withColumns({c: F.url_decode(c).cast(id_type) for c in ("id", "refers_to")})


def with_originals(records: DataFrame) -> DataFrame:
    """Revisits without a length get that of the response they refer to (one row per id and digest)."""
    wanted = records.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("d"), F.col("id").alias("i")).agg(F.max("payload_bytes").alias("n"))
    hit = (F.col("payload_digest") == F.col("d")) & (F.col("refers_to") == F.col("i"))
    return records.join(wanted, hit, "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "n")).drop("d", "i", "n")
