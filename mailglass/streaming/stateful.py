"""Keyed streams with state and event-time timers.

These run in a session whose state is kept by RocksDB (:func:`state_session`), which
timers and lists in state need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mailglass.operators.behavior import pair_totals

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MICROS = 86400 * 1000000
HOUR_MICROS = 3600 * 1000000


def state_session(spark: SparkSession) -> SparkSession:
    """A sibling session for streams with timers; the caller's own settings stay as they are."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    # a commit writes what changed, no row is looked up to count it, a join keeps one store a partition instead of four
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")
    own.conf.set("spark.sql.streaming.join.stateFormatVersion", "3")
    return own


def _micros(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1_000_000)


class OncePer(StatefulProcessor):
    """State: the time of a key's last emission. A timer forgets it when it can matter no more."""

    def __init__(self, interval: int):
        self.interval = interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        us = np.sort(np.concatenate([frame["us"].to_numpy(np.int64) for frame in rows]))
        last = self.last.get()[0] if self.last.exists() else None
        at, out = 0 if last is None else np.searchsorted(us, last + self.interval), []
        while at < len(us):  # one step per emission, not per row
            out.append(int(us[at]))
            at = np.searchsorted(us, out[-1] + self.interval)
        if out:
            if last is not None:
                self.handle.deleteTimer(self._due(last))
            self.last.update((out[-1],))
            self.handle.registerTimer(self._due(out[-1]))
            yield _emitted(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield _emitted(key, [])

    def _due(self, us: int) -> int:
        return -(-(us + self.interval) // 1000)


def _emitted(key, us: list[int]) -> pd.DataFrame:
    return pd.DataFrame({"key": pd.Series([key[0]] * len(us), dtype=object), "us": pd.Series(us, dtype="int64")})


def once_per_interval(events: DataFrame, key: str, ts: str = "timestamp", interval: str = "300 seconds", lateness: str = "10 minutes") -> DataFrame:
    """Each key once per interval, counted from its last emission: (key, ts).

    So a lookup is not repeated while its answer is fresh. Rows of a trigger are taken in
    time order; one that comes after a later emission finds that answer fresh and is
    dropped. Rows later than ``lateness`` are dropped by the watermark, null times as well.
    """
    kind = dict(events.dtypes)[key]
    keyed = events.filter(F.col(ts).isNotNull()).withWatermark(ts, lateness).select(F.col(key).alias("key"), ts, F.unix_micros(ts).alias("us"))
    out = keyed.groupBy("key").transformWithStateInPandas(OncePer(_micros(interval)), f"key {kind}, us long", "append", "eventTime")
    return out.select(F.col("key").alias(key), F.timestamp_micros("us").alias(ts))


TOTALS = "n long, last_us long, gap_days long, phishing long, hours array<long>"
SCORED = "id long, sender string, recipient string, prior_n long, prior_phishing int, prior_gap_days long, hour_seen long, history_risk double"
NOTHING = (0, 0, 0, 0, [0] * 24)


class PairHistory(StatefulProcessor):
    """State: a pair's totals, and its rows that the watermark has not passed yet.

    Rows wait in the buffer until their time is closed, then are scored in time order
    on the totals before them. The one timer of a pair stands at its earliest waiting
    row, or at the time when the pair is forgotten.
    """

    def __init__(self, ttl: int | None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", TOTALS)
        self.waiting = handle.getListState("waiting", "us long, id long, is_phishing long")
        self.due = handle.getValueState("due", "ms long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.totals.update((int(row["n"]), int(row["last_us"]), int(row["gap_days"]), int(row["phishing"]), [int(x) for x in row["hours"]]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for frame in rows:
            block = frame[["us", "id", "is_phishing"]].to_numpy(np.int64)
            earliest = min(int(block[:, 0].min()), earliest if earliest is not None else int(block[0, 0]))
            self.waiting.appendList([tuple(r) for r in block.tolist()])
        if earliest is not None:
            now = -(-earliest // 1000)
            due = self.due.get()[0] if self.due.exists() else None
            if due is None or now < due or not self._someone_waits(due):
                self._wait_until(now)
        yield _scored(key, *([[]] * 6))

    def _someone_waits(self, due: int) -> bool:
        """False where the timer is there to forget the pair, which new rows put off."""
        return self.ttl is None or due < -(-(self.totals.get()[1] + self.ttl) // 1000) if self.totals.exists() else True

    def _wait_until(self, ms: int) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        self.due.update((ms,))
        self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() * 1000
        self.due.clear()
        rows = np.array(sorted(self.waiting.get()), np.int64).reshape(-1, 3)
        ready, rest = rows[rows[:, 0] <= closed], rows[rows[:, 0] > closed]
        n, last, gaps, bad, hours = self.totals.get() if self.totals.exists() else NOTHING
        if not len(rows):  # nobody waited: the pair is old
            self.totals.clear()
            yield _scored(key, *([[]] * 6))
            return
        # a gap longer than the time to live begins a new pair
        before = np.append(last if n else ready[0, 0] if len(ready) else 0, ready[:-1, 0])
        fresh = np.flatnonzero(ready[:, 0] - before > self.ttl) if self.ttl is not None else []
        for part, first in zip(np.split(ready, fresh), [-1, *fresh]):
            if first >= 0:
                n, last, gaps, bad, hours = NOTHING
            if not len(part):
                continue
            us, ids, hits = part.T
            # whole days from the row before; the first row of a new pair has none
            gap = np.diff(us, prepend=last if n else us[0]) // DAY_MICROS
            total, worst = gaps + np.cumsum(gap), np.maximum(bad, np.maximum.accumulate(hits))
            prior, prior_bad = n + np.arange(len(us)), np.append(bad, worst[:-1])
            hour = pd.Series(us // HOUR_MICROS % 24)
            seen = np.asarray(hours, np.int64)[hour] + hour.groupby(hour).cumcount().to_numpy()
            yield _scored(key, ids, prior, prior_bad, np.append(gaps, total[:-1]), seen, _risk(prior, prior_bad))
            n, last, gaps, bad = n + len(us), int(us[-1]), int(total[-1]), int(worst[-1])
            hours = (np.asarray(hours, np.int64) + np.bincount(hour, minlength=24)).tolist()
        if len(ready):
            self.totals.update((n, last, gaps, bad, list(hours)))
        if len(rest):
            self.waiting.put([tuple(r) for r in rest.tolist()])
            self._wait_until(-(-int(rest[0, 0]) // 1000))
        else:
            self.waiting.clear()
            if self.ttl is not None:
                self._wait_until(-(-(last + self.ttl) // 1000))


def _risk(n: np.ndarray, phishing: np.ndarray) -> np.ndarray:
    return np.where(n == 0, 0.6, np.where(phishing > 0, 0.9, np.maximum(0.1, 0.5 - 0.1 * np.minimum(n, 4))))


def _scored(key, ids, n, phishing, gaps, seen, risk) -> pd.DataFrame:
    names = {"sender": pd.Series([key[0]] * len(ids), dtype=object), "recipient": pd.Series([key[1]] * len(ids), dtype=object)}
    return pd.DataFrame({"id": ids, **names, "prior_n": n, "prior_phishing": phishing, "prior_gap_days": gaps, "hour_seen": seen, "history_risk": risk})


def pair_state(history: DataFrame, start: DataFrame | None = None, lateness: str = "1 day", ttl: str | None = None) -> DataFrame:
    """Score every mail on what is known of its pair before it, then add it to that.

    ``history`` streams (id, sender, recipient, timestamp, is_phishing). ``start`` is a
    batch history of the same columns that ended before the stream begins; its pairs
    enter the state once, as totals. A row is scored when the watermark has passed
    its time, so rows that come late but within ``lateness`` count in their place
    and change no score already given; later ones are dropped. Rows of equal time
    go by id. With ``ttl`` a pair not seen for longer is forgotten: its next mail is a
    first contact, and its state goes when the watermark has passed that time.

    A pair's rows of one trigger go through one task: give the source an admission
    limit (``maxFilesPerTrigger`` or ``maxBytesPerTrigger``).
    """
    keys = ["sender", "recipient"]
    keyed = history.withWatermark("timestamp", lateness).select(
        "id", *keys, "timestamp", F.unix_micros("timestamp").alias("us"), F.col("is_phishing").cast("long").alias("is_phishing"))
    before = None if start is None else pair_totals(start).groupBy(*keys)
    return keyed.groupBy(*keys).transformWithStateInPandas(PairHistory(_micros(ttl) if ttl else None), SCORED, "append", "eventTime", before)
