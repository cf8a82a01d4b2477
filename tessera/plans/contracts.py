"""Declared reads: which filters, order, columns and limits a list may ask for, and admission."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters as L


@dataclass(frozen=True)
class Contract:
    key: str
    columns: tuple[str, ...]
    filters: tuple[str, ...]
    order: tuple[tuple[str, str], ...]
    most_rows: int = 500
    freshness: tuple[str, ...] = ("ready",)
    search_modes: tuple[str, ...] = ("none", "prefix")


_ORDER = (("created_s", "desc"), ("article_id", "desc"))
CONTRACTS = {
    c.key: c
    for c in (
        Contract("articles.list", ("article_id", "title", "created_s"), ("route", "year", "lang", "has_llm", "has_human", "duplicate", "conflict"), _ORDER),
        Contract("articles.export", ("article_id", "title", "route", "year", "created_s"), ("route", "year"), _ORDER, most_rows=100_000, freshness=("ready", "stale")),
        Contract("queue.unassessed", ("article_id", "prompt_id", "priority"), ("prompt_id",), (("priority", "asc"), ("article_id", "asc"), ("prompt_id", "asc"))),
    )
}


def admit(key: str, limit: int = 100, filters: dict | None = None, freshness: str = "ready", search_mode: str = "none") -> str:
    """``accept``, or why not."""
    c = CONTRACTS.get(key)
    if c is None:
        return "unknown contract"
    if set(filters or ()) - set(c.filters):
        return "unknown filter"
    if limit > c.most_rows:
        return "page too large"
    if limit <= 0:
        return "empty page"
    if freshness not in c.freshness:
        return "not ready"
    if search_mode not in c.search_modes:
        return f"{search_mode} search is a job"
    return "accept"


def admitted(requests: DataFrame) -> DataFrame:
    """:func:`admit` of a table of requests (contract, row_limit, filters, freshness, search_mode): adds ``decision``."""
    spark = requests.sparkSession
    rows = [(c.key, list(c.filters), c.most_rows, list(c.freshness), list(c.search_modes)) for c in CONTRACTS.values()]
    known = spark.createDataFrame(rows, "contract string, _filters array<string>, _most long, _fresh array<string>, _modes array<string>")
    why = (
        F.when(F.col("_most").isNull(), "unknown contract").when(F.size(F.array_except(F.coalesce("filters", F.array().cast("array<string>")), "_filters")) > 0, "unknown filter")
        .when(F.col("row_limit") > F.col("_most"), "page too large").when(F.col("row_limit") <= 0, "empty page").when(~F.array_contains("_fresh", F.col("freshness")), "not ready")
        .when(~F.array_contains("_modes", F.col("search_mode")), F.concat("search_mode", F.lit(" search is a job"))).otherwise("accept")
    )
    return requests.join(F.broadcast(known), "contract", "left").withColumn("decision", why).drop("_filters", "_most", "_fresh", "_modes")  # a row a contract


def shape_problems(df: DataFrame, tables: set[str], most_rows: int = 500) -> list[str]:
    """Why a foreground read is refused by its analysed plan: relations that aren't registered, joins without a key, and
    results that no limit or aggregation bounds."""
    plan = df._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    found = [f"unregistered relation {name}" for name in sorted(_relations(df) - tables)]
    if re.search(r"Join (Inner|Cross|LeftOuter|RightOuter|FullOuter)\s*$|Join Cross", text, re.M):
        found.append("join without a key")
    rows = plan.maxRows()
    if rows.isEmpty() or rows.get() > most_rows:
        found.append(f"more than {most_rows} rows")
    return found


def _relations(df: DataFrame) -> set[str]:
    """Last folder or file names, without extension, of what a plan reads."""
    return {f.rstrip("/").split("/")[-2 if "/part-" in f else -1].split(".")[0] for f in df.inputFiles()}


def read(key: str, table: DataFrame, filters: dict, limit: int = 100, cursor: str | None = None) -> DataFrame:
    """A page (and one row more) of a declared read, or ValueError with the reason."""
    why = admit(key, limit, filters)
    if why != "accept":
        raise ValueError(why)
    c = CONTRACTS[key]
    values = L.decode_cursor(cursor, contract=key, signature=L.signature(filters)) if cursor else None
    return L.page(table.where(L.state_filter(filters)).select(*c.columns), list(c.order), limit, values)


def cursor_after(key: str, filters: dict, row) -> str:
    return L.encode_cursor(contract=key, signature=L.signature(filters), values=[row[c] for c, _ in CONTRACTS[key].order])
