"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal updates.

Features of a text, all counted over the whole text and divided by their number:
single words and word pairs as they are written (letters folded), and runs of
one to three word shapes (case, length, kind, repeats the word before). Each is
hashed into one of ``buckets`` places, so a score is one sparse dot product.

Training: shards of a bounded sample of labelled rows are passed over in
parallel; after each pass the optimiser's sums of all shards are averaged on the
executors and sent out again. Only the averages (two numbers a bucket) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailglass.llm import textbytes as tb
from mailglass.llm.shared import class_share, materialize, share_per_class, text_of, tree_sum, uniform


@dataclass(frozen=True)
class Settings:
    """``per_class``: labelled rows of each class to train on, about; a classifier's
    fit needs no more. ``shards`` and ``passes``: see the module's text."""

    buckets: int = 1 << 18
    per_class: int = 6000
    shards: int = 6
    passes: int = 4
    alpha: float = 2.0
    beta: float = 1e-3
    l1: float = 2e-4
    l2: float = 1e-4
    seed: int = 7


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    upper = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 0x41) & (data <= 0x5A), out=upper[1:])
    digit = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 0x30) & (data <= 0x39), out=digit[1:])
    length = ends - starts
    mark = tb.WORD_OR_MARK[data[starts]] == 2
    many_upper = (upper[ends] - upper[starts]) * 2 > length
    some_upper = (upper[ends] - upper[starts]) > 0
    some_digit = (digit[ends] - digit[starts]) > 0
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    again &= ~first
    size = np.minimum(length, 12)
    shape = size + 16 * (many_upper + 2 * some_upper + 4 * some_digit + 8 * again)
    return np.where(mark, 1 << 12 | np.minimum(length, 4) << 8 | data[starts], shape).astype(np.uint64)


def features(data: np.ndarray, bounds: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature, row after row, and how many each row has."""
    starts, ends = tb.runs(data, bounds, tb.WORD_OR_MARK)
    counts = tb.row_counts(starts, bounds)
    words = tb.hash_runs(data, starts, ends)
    first = np.zeros(len(words), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    shapes = tb.mix(_shapes(data, starts, ends, words, first))
    kinds = [tb.ngrams(words, counts, n) for n in (1, 2)] + [tb.ngrams(shapes, counts, n) for n in (1, 2, 3)]
    total = np.sum([k for _, k in kinds], axis=0)
    out, at = np.empty(int(total.sum()), np.int64), np.cumsum(total) - total
    for salt, (grams, each) in enumerate(kinds):
        index = (tb.mix(grams ^ np.uint64(salt * 0x9E3779B9)) & np.uint64(buckets - 1)).astype(np.int64)
        place = np.arange(len(index)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(at, each)
        out[place] = index
        at = at + each
    return out, total


def weights_of(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """The weights that the FTRL sums stand for; small sums give exactly 0."""
    return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))


def train_pass(rows: list[tuple[np.ndarray, np.ndarray, float]], z: np.ndarray, n: np.ndarray, s: Settings) -> None:
    """One FTRL pass in place over (buckets, values, label) rows; the last place is the bias."""
    for index, value, label in rows:
        w = weights_of(z[index], n[index], s)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value
        sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / s.alpha
        z[index] += g - sigma * w
        n[index] += g * g


def _rows(batch: pa.RecordBatch, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    labels = batch.column("label").to_numpy(zero_copy_only=False)
    for first, data, bounds in tb.pieces(batch.column("text")):
        index, counts = features(data, bounds, s.buckets)
        at = 0
        for i, k in enumerate(counts):
            own, times = np.unique(index[at : at + k], return_counts=True)
            at += k
            yield np.append(own, s.buckets), np.append(times / max(k, 1), 1.0), float(labels[first + i])


def _shard_pass(sums, s: Settings):
    def run(table: pa.Table) -> pa.Table:
        z, n = (x.copy() for x in sums.value)
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        table = table.take(pa.array(np.random.default_rng(s.seed).permutation(table.num_rows)))
        for k in range(0, table.num_rows, 500):
            for batch in table.slice(k, 500).combine_chunks().to_batches():
                train_pass(_rows(batch, s), z, n, s)
        sums_of = np.concatenate([z, n]) * table.num_rows
        return pa.table({"part": table.column("shard").slice(0, 1), "weight": pa.array([table.num_rows], pa.float64()), "sums": pa.array([sums_of.tobytes()], pa.binary())})

    return run


def fit(documents: DataFrame, labels: DataFrame, train: Column, s: Settings = Settings()) -> np.ndarray:
    """Weights, the bias last. ``labels`` has doc_id and label (0 or 1); ``train`` is a
    condition on doc_id. Rows with a null id or label teach nothing; a document that
    is labelled twice counts twice. Without any label, or any text that has one, all
    weights are 0.

    Labels and ids are drawn first, so only the sample's texts are moved.
    """
    spark = documents.sparkSession
    known = labels.filter(train & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    shares = share_per_class(known, "label", s.per_class)
    drawn = known.filter(uniform("doc_id", seed=s.seed) < class_share("label", shares)).select("doc_id", F.col("label").cast("double"))
    shard = F.pmod(F.xxhash64("doc_id", F.lit(s.seed)), F.lit(s.shards))
    sample = materialize(documents.select("doc_id", text_of(documents).alias("text")).join(F.broadcast(drawn), "doc_id").select("text", "label", "doc_id", shard.alias("shard")))
    z, n = np.zeros(s.buckets + 1), np.zeros(s.buckets + 1)
    if not shares:
        return weights_of(z, n, s)
    for _ in range(s.passes):
        sums = spark.sparkContext.broadcast((z, n))
        parts = sample.groupBy("shard").applyInArrow(_shard_pass(sums, s), "part long, weight double, sums binary")
        averaged = tree_sum(parts, s.shards).collect()  # one row, of two numbers a bucket
        sums.destroy()
        if not averaged:
            break
        z, n = np.split(np.frombuffer(averaged[0].sums) / averaged[0].weight, 2)
    return weights_of(z, n, s)


def score(documents: DataFrame, weights: np.ndarray, s: Settings = Settings(), keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) and quality_score, 0 to 1, for every row.

    A null or empty text, or one of white space alone, gets the score of the bias.
    The weights are a table of fixed size.
    """
    keep = documents.columns if keep is None else keep
    model = documents.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    frame = documents.select(*keep, text_of(documents).alias("_scored_text"))
    schema = documents.select(*keep, F.lit(0.0).alias("quality_score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for first, data, bounds in tb.pieces(batch.column("_scored_text")):
                index, counts = features(data, bounds, s.buckets)
                raw = tb.row_sums(table[index], counts) / np.maximum(counts, 1) + float(table[-1])
                scores[first : first + len(counts)] = 1.0 / (1.0 + np.exp(-np.clip(raw, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores)], names=[*keep, "quality_score"])

    return frame.mapInArrow(run, schema)
