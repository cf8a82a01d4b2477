"""Publication identifiers in normal form: DOI, PMID, PMCID, arXiv, preprint DOIs, trusted URLs."""

from __future__ import annotations

import re
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructField, StructType

#: Hosts and prefixes by kind, and what a normal identifier looks like.
DOI_HOSTS = ("doi.org", "dx.doi.org")
PREFIXES = {"doi": ("doi:", "doi"), "pmid": ("pmid:", "pubmed:", "pmid"), "pmcid": ("pmcid:",), "arxiv": ("arxiv:",)}
SHAPES = {
    "doi": re.compile(r"10\.\S+/\S+"),
    "pmid": re.compile(r"[0-9]+"),
    "pmcid": re.compile(r"PMC[0-9]+"),
    "arxiv": re.compile(r"\d{4}\.\d{4,5}|[a-z-]+(?:\.[a-z]{2})?/\d{7}", re.I),
}
EDGES = " \t\r\n.,;:()[]{}<>\"'"


def _url(text: str) -> tuple[str, list[str]]:
    """Host without www. and path segments of an http(s) URL; else empty."""
    if not re.match(r"https?://", text, re.I):
        return "", []
    try:
        u = urlsplit(text)
    except ValueError:
        return "", []
    return (u.hostname or "").removeprefix("www."), [unquote(s) for s in u.path.split("/") if s]


def _bare(text: str, kind: str) -> str:
    low = text.lower()
    for p in PREFIXES[kind]:
        if low.startswith(p):
            return text[len(p) :].strip(EDGES)
    return text


def _doi(text: str) -> str:
    host, path = _url(text)
    return ("/".join(path) if host in DOI_HOSTS else _bare(text, "doi")).strip(EDGES).lower()


def _pmid(text: str) -> str:
    host, path = _url(text)
    if host == "pubmed.ncbi.nlm.nih.gov" and path:
        return path[0]
    if host == "ncbi.nlm.nih.gov" and path[:1] == ["pubmed"] and len(path) > 1:
        return path[1]
    return _bare(text, "pmid")


def _pmcid(text: str) -> str:
    host, path = _url(text)
    if host == "pmc.ncbi.nlm.nih.gov" or (host == "ncbi.nlm.nih.gov" and "pmc" in path):
        text = next((s for s in path if re.fullmatch(r"pmc\d+", s, re.I)), text)
    text = re.sub(r"\s+", "", _bare(text, "pmcid")).upper()
    return text if text.startswith("PMC") else f"PMC{text}"


def _versioned(text: str) -> tuple[str, str | None]:
    m = re.search(r"/?(v\d+)$", text, re.I)
    return (text[: m.start()], m[1].lower()) if m else (text, None)


def _arxiv(text: str) -> tuple[str, str | None]:
    host, path = _url(text)
    if host == "arxiv.org":
        text = "/".join(path[1:] if path[:1] in (["abs"], ["pdf"]) else path)
    else:
        text = _bare(text, "arxiv")
    bare = re.sub(r"\.pdf$", "", re.split(r"[?#]", text)[0], flags=re.I)
    m = re.search(r"v\d+$", bare, re.I)
    return (bare[: m.start()] if m else bare).lower(), m[0].lower() if m else None


def _preprint(text: str, source: str) -> tuple[str, str | None]:
    host, path = _url(text)
    if host == f"{source}.org":
        at = next((i for i, s in enumerate(path) if s.startswith("10.")), None)
        if at is not None:
            text = "/".join(path[at:])
    if _url(text)[0] in DOI_HOSTS:
        text = _doi(re.split(r"[?#]", text)[0])
    bare, version = _versioned(re.sub(r"(\.full)?(\.pdf)?$", "", re.split(r"[?#]", text.strip(EDGES))[0], flags=re.I))
    return _doi(bare), version


def normalize(kind: str | None, value: str | None) -> tuple[str, str | None, str | None, str | None]:
    """(status, kind, value, note): accepted, metadata (PMCIDs) or rejected with empty, malformed or
    unsupported-url; the note of an accepted one is its version, if any."""
    text = (value or "").strip(EDGES)
    if kind == "url":
        host, path = _url(text)
        if host in DOI_HOSTS:
            kind = "doi"
        elif host == "pmc.ncbi.nlm.nih.gov" or (host == "ncbi.nlm.nih.gov" and "pmc" in path):
            kind = "pmcid"
        elif host in ("pubmed.ncbi.nlm.nih.gov", "ncbi.nlm.nih.gov"):
            kind = "pmid"
        elif host in ("arxiv.org", "biorxiv.org", "medrxiv.org"):
            kind = host.removesuffix(".org")
        else:
            return "rejected", None, None, "unsupported-url" if text else "empty"
    if not text:
        return "rejected", None, None, "empty"
    version = None
    if kind == "doi":
        got = _doi(text)
    elif kind == "pmid":
        got = _pmid(text).strip(EDGES)
    elif kind == "pmcid":
        got = _pmcid(text)
    elif kind == "arxiv":
        got, version = _arxiv(text)
    elif kind in ("biorxiv", "medrxiv"):
        got, version = _preprint(text, kind)
        kind = "doi"
    else:
        return "rejected", None, None, "unsupported-kind"
    ok = SHAPES[kind].fullmatch(got) is not None
    if kind == "pmid":
        got = got.lstrip("0")
        ok = ok and got != ""
    if not ok:
        return "rejected", None, None, "malformed"
    return ("metadata" if kind == "pmcid" else "accepted"), kind, got, version


@pandas_udf(StructType([StructField(c, StringType()) for c in ("status", "kind", "value", "note")]))
def normalize_udf(kinds: pd.Series, values: pd.Series) -> pd.DataFrame:
    rows = [normalize(k, v) for k, v in zip(kinds, values, strict=True)]
    return pd.DataFrame(rows, columns=["status", "kind", "value", "note"])
