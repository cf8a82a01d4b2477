"""Predicates and list reads: dates, state groups, list modes, keyset pages, cursors, text search."""

from __future__ import annotations

import base64
import json
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIST_MODES = ("llm", "human", "both", "unassessed")


def date_range(col_s: Column, start: str | None, stop: str | None) -> Column:
    """Epoch seconds from ``start`` on and before ``stop``; a date-only ``stop`` means through that day."""
    to_s = lambda d: int(d.replace(tzinfo=timezone.utc).timestamp())
    out = F.lit(True)
    if start:
        out &= col_s >= to_s(datetime.fromisoformat(start))
    if stop:
        end = datetime.combine(date.fromisoformat(stop) + timedelta(days=1), datetime.min.time()) if len(stop) == 10 else datetime.fromisoformat(stop)
        out &= col_s < to_s(end)
    return out


def state_filter(groups: dict[str, list]) -> Column:
    """Any value within a group, all groups together; a boolean group with both values filters nothing."""
    out = F.lit(True)
    for name, values in groups.items():
        if not values or set(values) == {True, False}:
            continue
        out &= F.coalesce(F.col(name).isin(*values), F.lit(False))
    return out


def list_modes(has_llm: Column, has_human: Column) -> dict[str, Column]:
    """Membership in each list mode; an unknown flag is no membership (IS TRUE)."""
    yes = lambda c: c.eqNullSafe(F.lit(True))
    return {"llm": yes(has_llm), "human": yes(has_human), "both": yes(has_llm) & yes(has_human), "unassessed": ~yes(has_llm) & ~yes(has_human)}


def after(keys: list[tuple[str, str, object]]) -> Column:
    """Rows beyond a cursor: (column, asc or desc, last value) in sort order, nulls last; equal on a
    prefix and further on in the next column."""
    out, same = F.lit(False), F.lit(True)
    for name, way, value in keys:
        c, v = F.col(name), F.lit(value)
        if value is None:
            beyond = F.lit(False)  # nulls come last: only ties can follow
        else:
            beyond = F.coalesce((c > v) if way == "asc" else (c < v), F.lit(True))
        out |= same & beyond
        same &= c.eqNullSafe(v)
    return out


def page(df: DataFrame, order: list[tuple[str, str]], limit: int, cursor: list | None = None) -> DataFrame:
    """A keyset page of ``limit`` + 1 rows (the extra one tells that there is more)."""
    if cursor is not None:
        df = df.where(after([(c, way, v) for (c, way), v in zip(order, cursor, strict=True)]))
    return df.orderBy(*[F.asc_nulls_last(c) if way == "asc" else F.desc_nulls_last(c) for c, way in order]).limit(limit + 1)


def signature(filters: dict) -> str:
    """Stable base64url text of normalised filters: sorted keys, sorted distinct lists, empties dropped."""

    def plain(v):
        if isinstance(v, dict):
            kept = {k: plain(x) for k, x in sorted(v.items())}
            return {k: x for k, x in kept.items() if x not in (None, "", [], {})}
        if isinstance(v, (list, tuple, set)):
            return sorted({json.dumps(plain(x), sort_keys=True) for x in v if x not in (None, "")})
        return v

    text = json.dumps(plain(filters), sort_keys=True, separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def encode_cursor(**parts) -> str:
    return base64.urlsafe_b64encode(json.dumps(parts, sort_keys=True, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, **expected) -> list:
    """The values of a cursor; refuses one made for another snapshot, contract, sort or filter."""
    parts = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    for k, v in expected.items():
        if parts.get(k) != v:
            raise ValueError(f"the cursor was made for another {k}")
    return parts["values"]


def divide(df: DataFrame, item: str, group: str, needed: int) -> DataFrame:
    """Relational division: items that occur with ``needed`` distinct groups."""
    return df.groupBy(item).agg(F.count_distinct(group).alias("_n")).where(F.col("_n") == needed).select(item)


def prefix_search(tokens: DataFrame, prefixes: list[str], item: str = "article_id", token: str = "token") -> DataFrame:
    """Items of which, for every prefix, some token starts with it."""
    wanted = sorted({p for p in prefixes if p})
    if not wanted:
        return tokens.select(item).distinct()
    hit = F.array_compact(F.array(*[F.when(F.col(token).startswith(p), F.lit(i)) for i, p in enumerate(wanted)]))
    return divide(tokens.select(item, F.explode(hit).alias("_p")), item, "_p", len(wanted))


def contains_text(col: Column, query: str) -> Column:
    """Case-insensitive substring; no wildcards."""
    return F.contains(F.lower(col), F.lower(F.lit(query)))


def ranked_lookup(articles: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Exact ids first, then titles that contain the query, by title."""
    exact = F.col("article_id").cast("string") == query
    rank = F.when(exact, 0).otherwise(1)
    return articles.where(exact | contains_text(F.col("title"), query)).withColumn("rank", rank).orderBy("rank", "title", "article_id").limit(limit)
