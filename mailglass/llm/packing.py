"""Packing by optimal length buckets.

A global histogram of lengths is counted; dynamic programming over it picks the
bucket bounds with the least padding; inside each bucket, sequences form batches
of a token budget. Sequences longer than the context are cut into pieces first,
so the histogram never has more than ``context`` bars, and no token is lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailglass.llm.mixing import count_words, epoch_key
from mailglass.llm.shared import materialize

CONTEXT = 2048
BUCKETS = 12
BUDGET = 1 << 16


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """At most ``buckets`` upper bounds with the least padding, and that padding.

    Every length up to the greatest is in the bucket of the least bound not below it.
    Of equal solutions the one with the smallest bounds is taken.
    """
    order = np.argsort(lengths)
    v, c = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    m = len(v)
    if not m:
        return [], 0
    n, total = np.append(0, np.cumsum(c)), np.append(0, np.cumsum(c * v))
    far = np.iinfo(np.int64).max // 4
    best, choice = np.full(m + 1, far), []
    best[0] = 0
    for _ in range(min(buckets, m)):
        now, cut = np.full(m + 1, far), np.zeros(m + 1, np.int64)
        now[0] = 0
        for j in range(1, m + 1):  # the last bucket holds lengths i .. j - 1, padded to v[j - 1]
            cost = best[:j] + v[j - 1] * (n[j] - n[:j]) - (total[j] - total[:j])
            cut[j] = int(cost.argmin())
            now[j] = cost[cut[j]]
        choice.append(cut)
        best = now
    bounds, j = [], m
    for cut in reversed(choice):
        if j == 0:
            break
        bounds.append(int(v[j - 1]))
        j = int(cut[j])
    return bounds[::-1], int(best[m])


def cut_long(documents: DataFrame, length: Column, context: int) -> DataFrame:
    """Pieces of at most ``context`` tokens: piece, start, n_tokens, in place of each row. A row of no tokens has none."""
    pieces = F.ceil(F.col("n_tokens") / context).cast("int")
    each = documents.withColumn("n_tokens", length).filter("n_tokens > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    start = F.col("piece").cast("long") * context
    return each.withColumn("start", start).withColumn("n_tokens", F.least(F.col("n_tokens") - start, F.lit(context).cast("long")))


def pack(documents: DataFrame, context: int = CONTEXT, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = 3, slices: int = 1024) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bucket (its padded length), batch.

    ``documents`` has doc_id and text; tokens are words between white space. A batch
    of a bucket holds floor(budget / bucket) pieces, at least one; its number counts
    inside the bucket. A text without words makes no piece. Equal rows are pieces of
    their own. Order inside a bucket is that of a seeded hash: places are counted by
    slices of it, so a bucket that holds most rows is never sorted in one task.
    """
    narrow = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pieces = materialize(cut_long(narrow, count_words(F.col("text")), context).select("doc_id", "piece", "start", "n_tokens"))
    bars = pieces.groupBy("n_tokens").count().collect()  # at most ``context`` rows
    bounds, _ = best_bounds(np.array([b[0] for b in bars]), np.array([b[1] for b in bars]), buckets)
    bucket = F.lit(None).cast("long")
    for bound in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= bound, F.lit(bound).cast("long")).otherwise(bucket)
    key = epoch_key(F.col("doc_id"), F.col("piece"), seed)
    placed = pieces.withColumn("bucket", bucket).withColumn("_key", key).withColumn("_slice", F.conv(F.left("_key", F.lit(8)), 16, 10).cast("long") % slices)
    counts = placed.groupBy("bucket", "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("bucket").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("bucket", "_slice").orderBy("_key", "doc_id", "piece")
    room = F.greatest(F.floor(F.lit(budget) / F.col("bucket")), F.lit(1))
    ranked = placed.withColumn("_row", F.row_number().over(inside) - 1).join(counts, ["bucket", "_slice"])
    return ranked.select("doc_id", "piece", "start", "n_tokens", "bucket", F.floor((F.col("_before") + F.col("_row")) / room).alias("batch"))


def batches(packed: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row per batch: bucket, batch, doc_ids, pieces (in the same order), n_sequences, n_tokens, padding.

    A list is as long as the budget allows at most.
    """
    member = F.struct("doc_id", "piece", "n_tokens")
    rows = packed.groupBy("bucket", "batch").agg(F.array_sort(F.collect_list(member)).alias("m"))
    tokens = F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x["n_tokens"])
    return rows.select("bucket", "batch", F.col("m.doc_id").alias("doc_ids"), F.col("m.piece").alias("pieces"), F.size("m").cast("long").alias("n_sequences"), tokens.alias("n_tokens"), (F.col("bucket") * F.size("m") - tokens).alias("padding"))
