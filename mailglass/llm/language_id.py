"""Language identification with error-correcting output codes.

Each language has a codeword of bits. For each bit one linear classifier on
hashed byte n-grams of the whole text tells on which side of that bit's split a
text lies. The language whose codeword loses least, with each bit weighted by
how well its classifier does on the sample, wins; a close second is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailglass.llm import textbytes as tb
from mailglass.llm.shared import class_share, materialize, share_per_class, text_of, uniform

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``per_language``: about so many rows of each language are drawn to fit on.
    ``ambiguous``: below this score a text is flagged."""

    buckets: int = 1 << 16
    sizes: tuple[int, ...] = (2, 3, 4)
    per_language: int = 1500
    smoothing: float = 0.5
    steepness: float = 3.0
    ambiguous: float = 0.5
    seed: int = 11


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # buckets x bits
    scale: np.ndarray  # of each bit's margin
    trust: np.ndarray  # languages x bits, rows sum to 1


def codewords(n: int, seed: int) -> np.ndarray:
    """All different two-way splits for up to 7 languages, else random ones, checked for distance."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        bits = np.arange(1, 1 << (n - 1))
        codes = np.where(bits[None, :] >> np.arange(n - 1)[:, None] & 1, 1, -1)
        return np.vstack([codes, -np.ones(len(bits), int)]).astype(np.int8)
    rng, best, gap = np.random.default_rng(seed), None, -1
    width = int(np.ceil(10 * np.log2(n)))
    for _ in range(50):
        codes = np.where(rng.random((n, width)) < 0.5, -1, 1).astype(np.int8)
        codes = codes[:, np.abs(codes.sum(0)) < n]
        apart = (codes.shape[1] - codes.astype(int) @ codes.T.astype(int)) // 2
        np.fill_diagonal(apart, codes.shape[1])
        if apart.min() > gap:
            best, gap = codes, apart.min()
    return best


def grams(data: np.ndarray, bounds: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of bytes, letters folded, and how many each row has."""
    size = np.diff(bounds)
    counts = np.maximum(size - n + 1, 0)
    if len(data) < n:
        return np.empty(0, np.int64), np.zeros(len(size), np.int64)
    low = tb.LOWER[data].astype(np.uint32)
    h = np.zeros(len(data) - n + 1, np.uint32)
    for k in range(n):
        h = h * np.uint32(0x01000193) + low[k : len(data) - n + 1 + k]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    keep = np.ones(len(h), bool)
    for k in range(1, n):  # those that begin within n - 1 bytes of a row's end
        at = bounds[1:] - k
        keep[at[(at >= bounds[:-1]) & (at < len(h))]] = False
    return ((h ^ (h >> np.uint32(13))) & np.uint32(buckets - 1)).astype(np.int64)[keep], counts


def margins(data: np.ndarray, bounds: np.ndarray, weights: np.ndarray, s: Settings) -> np.ndarray:
    """Mean weight of each row's n-grams, per bit."""
    total, n = np.zeros((len(bounds) - 1, weights.shape[1])), np.zeros(len(bounds) - 1)
    for size in s.sizes:
        index, counts = grams(data, bounds, size, s.buckets)
        total += tb.row_sums(weights[index], counts)
        n += counts
    return total / np.maximum(n, 1)[:, None]


def fit(documents: DataFrame, train: Column, s: Settings = Settings()) -> Model:
    """Learn from text and ``lang`` of the rows that meet ``train``; null lang teaches nothing."""
    known = documents.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares = share_per_class(known, "lang", s.per_language)
    languages = sorted(shares)
    place = {x: i for i, x in enumerate(languages)}
    sample = materialize(known.filter(uniform("doc_id", "text", seed=s.seed) < class_share("lang", shares)).select("text", "lang").repartition(6))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), s.buckets))
        for batch in batches:
            own = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            for first, data, bounds in tb.pieces(batch.column("text")):
                for n in s.sizes:
                    index, counts = grams(data, bounds, n, s.buckets)
                    at = np.repeat(own[first : first + len(counts)], counts) * s.buckets + index
                    sums += np.bincount(at, minlength=sums.size).reshape(sums.shape)
        for i in np.flatnonzero(sums.any(1)):
            yield pa.RecordBatch.from_pydict({"language": [int(i)], "sums": [sums[i].tobytes()]})

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py()) for x in table.column("sums")], axis=0)
        return pa.table({"language": table.column("language").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    sums = np.zeros((len(languages), s.buckets))
    parts = sample.mapInArrow(count, "language long, sums binary")
    for row in parts.groupBy("language").applyInArrow(add, "language long, sums binary").collect():  # one row a language, of fixed size
        sums[row.language] += np.frombuffer(row.sums)
    codes = codewords(len(languages), s.seed)
    share = sums / np.maximum(sums.sum(1, keepdims=True), 1)  # every language counts the same
    floor = s.smoothing / max(1.0, sums.sum() / max(1, len(languages)))
    weights = np.zeros((s.buckets, codes.shape[1] if len(languages) else 1), np.float32)
    for b in range(codes.shape[1] if len(languages) > 1 else 0):
        one, other = share[codes[:, b] > 0].mean(0), share[codes[:, b] < 0].mean(0)
        weights[:, b] = np.log((one + floor) / (other + floor))
    model = Model(languages, codes, weights, np.ones(weights.shape[1]), np.full(codes.shape, 1 / max(1, codes.shape[-1])))
    if len(languages) > 1:
        _trust(sample, model, place, s)
    return model


def _trust(sample: DataFrame, model: Model, place: dict, s: Settings) -> None:
    """Each bit's usual margin, and for each language how often each bit comes out right."""
    held = sample.sparkSession.sparkContext.broadcast(model)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, out = held.value, np.zeros((2, *model_shape))
        rows = np.zeros(model_shape[0])
        for batch in batches:
            own = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            for first, data, bounds in tb.pieces(batch.column("text")):
                f = margins(data, bounds, m.weights, s)
                mine = own[first : first + len(f)]
                np.add.at(out[0], mine, np.sign(f) == m.codes[mine])
                np.add.at(out[1], mine, np.abs(f))
                np.add.at(rows, mine, 1)
        yield pa.RecordBatch.from_pydict({"rows": [rows.tobytes()], "sums": [out.tobytes()]})

    model_shape = model.codes.shape
    rows, sums = np.zeros(model_shape[0]), np.zeros((2, *model_shape))
    for row in sample.mapInArrow(check, "rows binary, sums binary").collect():  # three numbers a language and bit, from six tasks
        rows += np.frombuffer(row.rows)
        sums += np.frombuffer(row.sums).reshape(sums.shape)
    right = sums[0] / np.maximum(rows, 1)[:, None]
    model.trust = np.maximum(right, 1e-3) / np.maximum(right, 1e-3).sum(1, keepdims=True)
    model.scale = np.maximum(sums[1].sum(0) / max(1.0, rows.sum()), 1e-9)
    held.destroy()


def decode(f: np.ndarray, model: Model, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Index of the codeword with the least weighted logistic loss, and a score from 0 to 1."""
    f = np.clip(f / model.scale, -8, 8) * s.steepness
    loss = np.stack([(np.logaddexp(0, -f * code) * trust).sum(1) for code, trust in zip(model.codes, model.trust)], axis=1)
    loss *= model.codes.shape[1]
    p = np.exp(loss.min(1, keepdims=True) - loss)
    p /= p.sum(1, keepdims=True)
    return loss.argmin(1), p.max(1)


def identify(documents: DataFrame, model: Model, s: Settings = Settings(), keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all), lang_pred, lang_score and lang_ambiguous for every row.

    A null text and a text without a letter are ``und`` with score 0 and not
    ambiguous; so is every text if nothing was learned.
    """
    keep = documents.columns if keep is None else keep
    held = documents.sparkSession.sparkContext.broadcast(model)
    letter = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    frame = documents.select(*keep, text_of(documents).alias("_scored_text"), letter.alias("_has_letter"))
    schema = documents.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("lang_score"), F.lit(False).alias("lang_ambiguous")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            known = batch.column("_has_letter").to_numpy(zero_copy_only=False).astype(bool) & bool(m.languages)
            best, scores = np.full(batch.num_rows, len(m.languages)), np.zeros(batch.num_rows)
            for first, data, bounds in tb.pieces(batch.column("_scored_text"), tb.PIECE // 2):
                if m.languages:
                    rows = slice(first, first + len(bounds) - 1)
                    best[rows], scores[rows] = decode(margins(data, bounds, m.weights, s), m, s)
            best[~known], scores[~known] = len(m.languages), 0.0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(names[best], pa.string()), pa.array(scores), pa.array(known & (scores < s.ambiguous))],
                names=[*keep, "lang_pred", "lang_score", "lang_ambiguous"])

    return frame.mapInArrow(run, schema)
