"""Text helpers: title tokens, chunking, tolerant JSON, merge patches."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType


@pandas_udf(StringType())
def strip_accents(texts: pd.Series) -> pd.Series:
    """Canonical decomposition without combining marks; Spark has no built-in for it."""

    def bare(t: str | None) -> str | None:
        if t is None or t.isascii():
            return t
        return "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))

    return texts.map(bare)


def title_tokens(title: Column) -> Column:
    """Distinct non-empty runs of a-z and 0-9 of the lower-cased, accent-free title."""
    return F.array_distinct(F.filter(F.split(F.lower(strip_accents(title)), "[^a-z0-9]+"), lambda t: t != ""))


def approx_tokens(text: Column) -> Column:
    return F.ceil(F.char_length(text) / 4).cast("long")


def strip_images(text: Column) -> Column:
    """Drop Markdown images whose target is inlined data."""
    return F.regexp_replace(text, r"!\[[^\]]*\]\(data:image/[^)]*\)", "")


_HEADING = re.compile(r"^#{1,6} ", re.M)
_BLANK = re.compile(r"\n\s*\n+")


def _pieces(text: str, limit: int) -> Iterator[str]:
    for at in range(0, len(text), limit):
        yield text[at : at + limit]


def _paragraphs(text: str) -> list[str]:
    """Paragraphs with the blank lines that follow them."""
    ends = [m.end() for m in _BLANK.finditer(text)]
    cuts = [0, *ends, len(text)]
    out = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    return out if not ends or cuts[-2] != len(text) else [*out[:-1], ""]


def _fill(parts: list[str], limit: int) -> list[str]:
    """Join neighbours greedily up to ``limit`` characters."""
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + len(p) <= limit:
            out[-1] += p
        elif p or not out:
            if out and not out[-1]:
                out[-1] = p
            else:
                out.append(p)
    return out or [""]


def _fitted(section: str, limit: int) -> list[str]:
    """A section as parts within the limit; one that begins with a heading repeats that line on each."""
    if len(section) <= limit:
        return [section]
    head, room = "", limit
    if re.match(r"#{1,6} ", section):
        line = section.find("\n") + 1 or len(section)
        if line < limit:
            head, room, section = section[:line], limit - line, section[line:]
        else:
            return list(_pieces(section, limit))
    small = [x for p in _paragraphs(section) for x in (_pieces(p, room) if len(p) > room else [p])]
    return [head + x for x in _fill(small, room)] if head else small


def chunk_text(text: str, limit: int) -> tuple[str, list[str]]:
    """(strategy, chunks): sections by heading, else paragraphs, packed greedily up to ``limit``."""
    if limit <= 0:
        return ("article_heading_greedy" if _HEADING.search(text) else "article_paragraph_greedy"), [""]
    starts = [m.start() for m in _HEADING.finditer(text)]
    if starts:
        cuts = sorted({0, *starts, len(text)})
        sections = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    else:
        sections = _paragraphs(text)
    parts = [x for s in sections for x in _fitted(s, limit)]
    return ("article_heading_greedy" if starts else "article_paragraph_greedy"), _fill(parts, limit)


def chunk_sections(markdown: str, limit: int) -> list[str]:
    """Level-3 sections packed greedily; the text before the first one is repeated on every chunk."""
    starts = [m.start() for m in re.finditer(r"^### ", markdown, re.M)]
    prefix = markdown[: starts[0]] if starts else markdown
    if len(prefix) >= limit:
        return [prefix[: max(0, limit)]]
    room = limit - len(prefix)
    cuts = [*starts, len(markdown)]
    parts = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in _fitted(markdown[a:b], room)]
    return [prefix + x for x in _fill(parts, room)] if parts else [prefix]


def chunks_udf(limit: int):
    """text -> struct(strategy, chunks)."""

    @pandas_udf(StructType([StructField("strategy", StringType()), StructField("chunks", ArrayType(StringType()))]))
    def run(texts: pd.Series) -> pd.DataFrame:
        out = [chunk_text(t or "", limit) for t in texts]
        return pd.DataFrame({"strategy": [s for s, _ in out], "chunks": [c for _, c in out]})

    return run


_FENCE = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.S | re.I)
_BAD_ESCAPE = re.compile(r"\\(?:(\\)|(?![\"/bfnrtu]))")


def tolerant_json(text: str | None) -> tuple[str | None, str]:
    """(JSON text or null, how it was read): plain, extracted from a fence or brackets, or with
    invalid backslashes doubled; ``failed`` if nothing helps."""
    if text is None:
        return None, "failed"

    def valid(t: str) -> bool:
        try:
            json.loads(t)
            return True
        except ValueError:
            return False

    def payload(t: str) -> str | None:
        fence = _FENCE.search(t)
        if fence and fence[1].strip()[:1] in ("{", "["):
            return fence[1].strip()
        start = min((i for i in (t.find("{"), t.find("[")) if i >= 0), default=-1)
        stop = max(t.rfind("}"), t.rfind("]"))
        return t[start : stop + 1].strip() if 0 <= start <= stop else None

    doubled = lambda t: _BAD_ESCAPE.sub(lambda m: "\\\\", t)
    if valid(text):
        return text, "plain"
    inner = payload(text)
    for candidate, how in ((inner, "extracted"), (inner and doubled(inner), "repaired"), (doubled(text), "repaired")):
        if candidate is not None and valid(candidate):
            return candidate, how
    return None, "failed"


@pandas_udf(StructType([StructField("json", StringType()), StructField("how", StringType())]))
def tolerant_json_udf(texts: pd.Series) -> pd.DataFrame:
    out = [tolerant_json(t) for t in texts]
    return pd.DataFrame({"json": [a for a, _ in out], "how": [b for _, b in out]})


def merge_patch(target, patch):
    """RFC 7396: objects merge member by member, null deletes, anything else replaces."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_patch(out.get(k), v)
    return out


@pandas_udf(StringType())
def merge_patch_udf(targets: pd.Series, patches: pd.Series) -> pd.Series:
    def one(a, b):
        if a is None or b is None:
            return a if b is None else b
        return json.dumps(merge_patch(json.loads(a), json.loads(b)), separators=(",", ":"), ensure_ascii=False)

    return pd.Series([one(a, b) for a, b in zip(targets, patches, strict=True)])


def within_budget(system: str, user: str, context: int, completion: int) -> tuple[bool, int, int]:
    """(fits, prompt tokens, prompt and completion tokens), four characters a token."""
    n = math.ceil((len(system) + len(user)) / 4)
    return n <= context, n, n + completion


def remap_keys(found: list[str], expected: list[str]) -> dict[str, str]:
    """Found key -> expected key: equal ones first, then those one edit apart, each used once."""

    def near(a: str, b: str) -> bool:
        if abs(len(a) - len(b)) > 1:
            return False
        i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]

    out = {k: k for k in found if k in expected}
    free = [k for k in expected if k not in out]
    for k in found:
        hit = next((e for e in free if k not in out and near(k, e)), None)
        if hit is not None:
            out[k] = hit
            free.remove(hit)
    return out


def remapped(found: Column, expected: Column) -> Column:
    """:func:`remap_keys` of two array columns: structs (found, expected)."""
    equal = F.transform(F.array_intersect(found, expected), lambda k: F.struct(k.alias("found"), k.alias("expected")))

    def step(state: Column, k: Column) -> Column:
        hit = F.try_element_at(F.filter(state["free"], lambda e: F.levenshtein(k, e) <= 1), F.lit(1))
        free = F.when(hit.isNull(), state["free"]).otherwise(F.array_remove(state["free"], hit))
        pairs = F.when(hit.isNull(), state["pairs"]).otherwise(F.array_append(state["pairs"], F.struct(k.alias("found"), hit.alias("expected"))))
        return F.struct(free.alias("free"), pairs.alias("pairs"))

    none = F.array().cast("array<struct<found:string,expected:string>>")
    start = F.struct(F.array_except(expected, found).alias("free"), none.alias("pairs"))
    return F.concat(equal, F.aggregate(F.array_except(found, expected), start, step)["pairs"])


def valid_quotes(text: Column, quotes: Column) -> Column:
    """Distinct quotes that occur in the text, both with white space collapsed and lower-cased."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return F.array_distinct(F.filter(quotes, lambda q: (plain(q) != "") & F.contains(plain(text), plain(q))))
