"""Small string and list expressions used across the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """Regex group of the first match, null instead of '' when absent."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def compact(items: Iterable[Column]) -> Column:
    """Array of the non-null items, in order."""
    return F.array_compact(F.array(*items))


def flag(condition: Column, value: Column | str) -> Column:
    """``value`` where the condition holds, else null."""
    return F.when(condition, F.lit(value) if isinstance(value, str) else value)


def strings(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """True when any of the fixed terms occurs in the text."""
    result = F.lit(False)
    for term in terms:
        result = result | F.contains(text, F.lit(term))
    return result


def count_true(conditions: Iterable[Column]) -> Column:
    """How many of the conditions hold."""
    total = F.lit(0)
    for condition in conditions:
        total = total + F.when(condition, 1).otherwise(0)
    return total


def weighted_mean(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean over the non-null scores, null when all are null."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, score in scores.items():
        total = total + F.coalesce(score * F.lit(weights[name]), F.lit(0.0))
        weight = weight + F.when(score.isNotNull(), F.lit(weights[name])).otherwise(F.lit(0.0))
    return F.when(weight > 0, total / weight)
