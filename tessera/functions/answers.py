"""Answers: normal form, binary decision, answer-type strategies."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_strings(text: Column) -> Column:
    """String members of a JSON array, in order; null unless the text is an array.

    Other members (numbers, objects) are left out rather than turned into text: the array is read as
    variants and only those of string type are kept."""
    parts = F.from_json(F.when(text.rlike(r"^\s*\["), text), "array<variant>", {"mode": "PERMISSIVE"})
    strings = F.filter(parts, lambda v: F.schema_of_variant(v) == "STRING")
    return F.transform(strings, lambda v: F.try_variant_get(v, "$", "string"))


def members(listed: Column, json_text: Column, plain: Column) -> Column:
    """Answer members: a list answer, else JSON-array text, else the plain text; trimmed, blanks dropped."""
    raw = F.coalesce(listed, json_strings(json_text), F.array(plain))
    return F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")


def normalized(listed: Column, json_text: Column, plain: Column) -> Column:
    """Lower-cased distinct members in first-seen order."""
    return F.array_distinct(F.transform(members(listed, json_text, plain), lambda x: F.lower(x)))


def decision(answers: Column) -> Column:
    """include / exclude for a single yes, maybe or no; null for anything else."""
    only = F.when(F.size(answers) == 1, answers[0])
    return F.when(only.isin("yes", "maybe"), "include").when(only == "no", "exclude")


def enum_values(answer_type: str) -> list[str]:
    """Quoted members of a union type such as ``'yes' | 'no'``."""
    return [a or b for a, b in re.findall(r"'([^']*)'|\"([^\"]*)\"", answer_type)]


def filter_strategy(answer_type: str | None) -> str:
    """How answers of a type can be filtered: enum, numeric or open."""
    kind = (answer_type or "").strip()
    if enum_values(kind):
        return "enum"
    base = kind.removesuffix("[]").strip().lower()
    parts = {p.strip() for p in base.split("|")} - {"null", "undefined"}
    return "numeric" if parts and parts <= {"number", "integer", "number.integer"} else "open"


def options_of(answer_type: Column) -> Column:
    """:func:`enum_values` of a column."""
    quoted = F.regexp_extract_all(F.coalesce(answer_type, F.lit("")), F.lit(r"""'[^']*'|"[^"]*\""""), F.lit(0))
    return F.transform(quoted, lambda q: F.substring(q, F.lit(2), F.length(q) - 2))


def strategy_of(answer_type: Column) -> Column:
    """:func:`filter_strategy` of a column."""
    base = F.lower(F.trim(F.regexp_replace(F.trim(F.coalesce(answer_type, F.lit(""))), r"\[\]$", "")))
    names = lambda *n: F.array(*[F.lit(x) for x in n])
    parts = F.array_except(F.transform(F.split(base, r"\|"), lambda p: F.trim(p)), names("null", "undefined"))
    numeric = (F.size(parts) > 0) & (F.size(F.array_except(parts, names("number", "integer", "number.integer"))) == 0)
    return F.when(F.size(options_of(answer_type)) > 0, "enum").when(numeric, "numeric").otherwise("open")


def unexpected(answers: Column, allowed: list[str]) -> Column:
    """Null, blank or empty answers, and those with a member outside ``allowed``."""
    options = F.array(*[F.lit(a) for a in allowed])
    return answers.isNull() | (F.size(answers) == 0) | F.exists(answers, lambda x: x.isNull() | (F.trim(x) == "") | ~F.array_contains(options, x))
