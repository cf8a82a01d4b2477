"""Rater-agreement measures as Column expressions over counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def kappa(pairs: Column, agree: Column, left_in: Column, left_out: Column, right_in: Column, right_out: Column) -> Column:
    """Cohen's kappa of two binary raters; with chance agreement of 1 it is 1 if they agree, else null."""
    seen = rate(agree, pairs)
    chance = rate(left_in, pairs) * rate(right_in, pairs) + rate(left_out, pairs) * rate(right_out, pairs)
    return F.when(pairs > 0, F.when(chance == 1, F.when(seen == 1, 1.0)).otherwise((seen - chance) / (1 - chance)))


def confusion(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Measures of decisions against a truth, by name; null where undefined."""
    sens, spec = rate(tp, tp + fn), rate(tn, tn + fp)
    return {
        "accuracy": rate(tp + tn, tp + tn + fp + fn),
        "balanced_accuracy": (sens + spec) / 2,
        "f1": rate(2 * tp, 2 * tp + fp + fn),
        "npv": rate(tn, tn + fn),
        "precision": rate(tp, tp + fp),
        "sensitivity": sens,
        "specificity": spec,
        "prevalence": rate(tp + fn, tp + tn + fp + fn),
    }


def mcnemar(only_left: Column, only_right: Column) -> Column:
    """McNemar's statistic with continuity correction; null without discordant pairs."""
    n = only_left + only_right
    return F.when(n > 0, F.pow(F.abs(only_left - only_right) - 1, F.lit(2)) / n)


def winner(left: Column, right: Column, left_name: str, right_name: str, tie: str = "Tie") -> Column:
    return F.when(left > right, left_name).when(right > left, right_name).otherwise(tie)
