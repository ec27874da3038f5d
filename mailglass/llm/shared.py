"""The shared folder as executors' Python sees it, samples and fold expressions."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailglass.session import materialize, shared_folder  # noqa: F401  (materialize is used by the operators)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new path under the cluster's shared folder, with its scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/llm-{kind}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def open_folder(uri: str):
    """(file system, path) for pyarrow: local, HDFS or an object store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def fold(key: Column | str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as an empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def uniform(*keys: Column | str, seed: int = 0) -> Column:
    """A repeatable number from 0 to 1 per key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))


def share_per_class(df: DataFrame, label: str, bound: int) -> dict:
    """For each value of ``label`` the share of rows that makes about ``bound`` rows of it.

    The list is as long as the number of classes.
    """
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).count().collect()
    return {r[0]: min(1.0, bound / r[1]) for r in counts}


def class_share(label: str, shares: dict) -> Column:
    share = F.lit(0.0)
    for value, part in shares.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(part)).otherwise(share)
    return share


@contextmanager
def bloom_filtered(spark: SparkSession):
    """While it lasts, joins filter the longer side by a Bloom filter of the shorter one's
    keys whatever the longer side's size; by default Spark does so from 10 GB on."""
    key = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "0")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tree_sum(parts: DataFrame, n: int, fan: int = 32) -> DataFrame:
    """One row: weight and element-wise sums of ``n`` parts (part, weight, sums), added up
    ``fan`` at a time, so that no task sees more. ``sums`` are doubles as bytes."""
    while True:
        parts = parts.withColumn("part", F.floor(F.col("part") / fan).cast("long")).groupBy("part").applyInArrow(_sum, "part long, weight double, sums binary")
        n = -(-n // fan)
        if n <= 1:
            return parts


def _sum(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x.as_py()) for x in table.column("sums")], axis=0)
    return pa.table({"part": table.column("part").slice(0, 1), "weight": pa.array([sum(table.column("weight").to_pylist())], pa.float64()), "sums": pa.array([total.tobytes()], pa.binary())})
