"""Registry of runnable queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str | Callable[[], str]] = {}


def query(name: str, oracle: str | Callable[[], str] | None = None):
    """Register a query under ``name``, with check SQL where SQL can say it."""

    def wrap(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return wrap


def joined(column: str | Column, separator: str = " | ") -> Column:
    """An array as one string, so both engines compare it the same way."""
    return F.array_join(F.col(column) if isinstance(column, str) else column, separator)


def r6(column: str | Column) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)
