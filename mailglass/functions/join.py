"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailglass.session import materialize


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of a plan, None where it is not reachable."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # Spark Connect has no plan handle
        return None


def broadcast_limit(df: DataFrame) -> int:
    """The session's own broadcast limit in bytes, whatever unit it is written in."""
    value = str(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")).strip().lower()
    number = value.rstrip("bkmgtpi")
    unit = value[len(number):].rstrip("b").rstrip("i")
    return int(number) * 1024 ** " kmgtp".index(unit or " ")


def fits_broadcast(df: DataFrame) -> bool:
    """True when the estimate is below the session's own broadcast limit."""
    size = estimated_bytes(df)
    return size is not None and 0 <= size <= broadcast_limit(df)


def hot_keys(facts: DataFrame, on: list[str], hot_rows: int, *measures: Column) -> tuple[list[Row], float]:
    """Keys with more than ``hot_rows`` rows and more than 1/10000 of all rows,
    with that limit. By the second test there are fewer than 10000 of them, so
    the list is short whatever the data."""
    limit = max(float(hot_rows), facts.count() / 10000)
    counts = facts.groupBy(*on).agg(F.count("*").alias("_rows"), *measures).filter(F.col("_rows") > limit)
    return counts.collect(), limit


def lookup_join(facts: DataFrame, dim: DataFrame, on: list[str], spread_by: str, hot_rows: int = 1000000, true_size: bool = False) -> DataFrame:
    """Left join to a table with one row per key.

    Estimates multiply over joins, so a dimension that seems to be above the
    broadcast limit is written once and judged by its true size; ``true_size`` says
    that it is a plain scan, whose estimate holds. Below the limit the join is left
    to Spark. Otherwise the keys of the facts are counted when
    the plan is built. Without hot keys this is a plain join. With some, the
    dimension rows of the hot keys are repeated and their facts are spread over
    the copies by ``spread_by``, about one copy for each limit's worth of rows;
    all other keys are joined as they are. Facts without a key match nothing and
    are spread freely.
    """
    if not true_size and not fits_broadcast(dim):
        dim = materialize(dim)
    if fits_broadcast(dim):
        return facts.join(dim, on, "left")
    found, limit = hot_keys(facts, on, hot_rows)
    if not found:
        return facts.join(dim, on, "left")
    spark = facts.sparkSession
    keyed = [r for r in found if all(r[c] is not None for c in on)]
    schema = facts.select(*on).schema.add("_copies", T.IntegerType())
    hot = spark.createDataFrame([(*[r[c] for c in on], math.ceil(r["_rows"] / limit)) for r in keyed], schema)
    no_key = F.lit(False)
    for name in on:
        no_key = no_key | F.col(name).isNull()
    spread = F.xxhash64(spread_by)
    # a local table of fewer than 10000 rows, see hot_keys
    salted = facts.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(no_key, F.pmod(spread, F.lit(65536))).otherwise(
        F.pmod(spread, F.coalesce("_copies", F.lit(1)))).cast("int")).drop("_copies")
    copies = dim.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).drop("_copies")
    return salted.join(copies, [*on, "_salt"], "left").drop("_salt")
