"""URL rules by a sorted digest array.

Rules (a host, a path prefix, allow or block) are kept as a sorted array of 64-bit xxHash keys of
``host/path`` that workers map into memory, beside the full rule strings. Every (host suffix, path
prefix) combination of a URL that some rule could have is hashed, looked up by a vectorised binary
search and, on a hit, confirmed against the stored string, as keys may collide.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The rules of the query, as (verdict, host/path).
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
DEFAULT = "allow"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = common.lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def digest_array(rules, folder: str) -> dict[str, str]:
    """Write the sorted keys, string ends, strings and verdicts as .npy files; their paths by name.

    Of repeated rules the last one counts. No rules: empty arrays.
    """
    import xxhash

    last = {rule: verdict for verdict, rule in rules}
    rows = sorted((xxhash.xxh64_intdigest(rule), rule, verdict) for rule, verdict in last.items())
    blobs = [rule.encode() for _, rule, _ in rows]
    arrays = {
        "keys": np.array([k for k, _, _ in rows], np.uint64),
        "ends": np.cumsum([len(x) for x in blobs], dtype=np.int64) if rows else np.empty(0, np.int64),
        "text": np.frombuffer(b"".join(blobs), np.uint8),
        "block": np.array([v == "block" for _, _, v in rows], bool),
        "lengths": np.array(sorted({len(rule) - rule.index("/") for _, rule, _ in rows}), np.int64),
    }
    out = {}
    for name, a in arrays.items():
        out[name] = os.path.join(folder, f"{os.path.basename(folder)}-{name}.npy")
        np.save(out[name], a)
    return out


class Rules:
    """Memory-mapped rules. ``judge(hosts, paths)`` gives (rule or None, blocked or None) lists."""

    def __init__(self, files: dict[str, str]):
        load = lambda n: np.load(files[n], mmap_mode="r") if os.path.getsize(files[n]) > 128 else np.load(files[n])
        self.keys, self.ends, self.text, self.block = (load(n) for n in ("keys", "ends", "text", "block"))
        self.lengths = np.load(files["lengths"]).tolist()

    def rule(self, k: int) -> str:
        return bytes(self.text[self.ends[k - 1] if k else 0 : self.ends[k]]).decode()

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list, list]:
        import xxhash

        tries: dict[str, int] = {}
        row_tries: list[list[int]] = []
        seen: dict[tuple[str, str], list[int]] = {}
        deepest = self.lengths[-1] if self.lengths else 0
        for host, path in zip(hosts, paths, strict=True):
            head = path[:deepest]
            if (host, head) not in seen:
                own, suffix = [], host
                while True:
                    for n in self.lengths:
                        if n <= len(head):
                            own.append(tries.setdefault(f"{suffix}{head[:n]}", len(tries)))
                    at = suffix.find(".")
                    if at < 0:
                        break
                    suffix = suffix[at + 1 :]
                seen[host, head] = own
            row_tries.append(seen[host, head])
        names = list(tries)
        found: dict[int, int] = {}
        if names and len(self.keys):
            keys = np.fromiter((xxhash.xxh64_intdigest(t) for t in names), np.uint64, len(names))
            at = np.searchsorted(self.keys, keys)
            for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys):
                k = int(at[i])
                while k < len(self.keys) and self.keys[k] == keys[i]:
                    if self.rule(k) == names[i]:  # else a collision of keys
                        found[int(i)] = k
                        break
                    k += 1
        rules, blocked = [], []
        for own in row_tries:
            best = max((i for i in own if i in found), key=lambda i: (len(names[i]), names[i].index("/")), default=None)
            rules.append(None if best is None else names[best])
            blocked.append(None if best is None else bool(self.block[found[best]]))
        return rules, blocked


_MAPPED: dict[str, Rules] = {}


def judge_urls(pages: DataFrame, rules=RULES, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row.

    A rule ``host/path`` fits its host and all subdomains of it where the path begins with the
    rule's; the longest string wins (equal lengths: the longer host). Without a rule: null and
    ``default``. Null urls and urls without ``://`` have an empty host and path. The rule files go
    to the workers with the application's own file server, one copy an executor.
    """
    spark: SparkSession = pages.sparkSession
    common.ship(spark)
    folder = tempfile.mkdtemp(prefix="url-rules-")
    names = {}
    for key, path in digest_array(rules, folder).items():
        spark.sparkContext.addFile(path)
        names[key] = os.path.basename(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if names["keys"] not in _MAPPED:
            _MAPPED[names["keys"]] = Rules({k: SparkFiles.get(v) for k, v in names.items()})
        rule_set = _MAPPED[names["keys"]]
        for b in batches:
            found, blocked = rule_set.judge(b.column(1).to_pylist(), b.column(2).to_pylist())
            verdict = [default if x is None else "block" if x else "allow" for x in blocked]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, pa.string()), pa.array(verdict, pa.string())], ["id", "host", "path", "rule", "verdict"])

    host, path = split_url(pages[url_col])
    src = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"))
    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
