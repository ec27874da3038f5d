"""Streams over many triggers: late rows, state from history, timers, retries."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mailglass.operators import behavior
from mailglass.plans import queries_streaming
from mailglass.plans.queries_verdict import snapshots
from mailglass.plans.bindings import view
from mailglass.streaming import monitors, stateful

START = dt.datetime(2024, 1, 1)
SCHEMA = "id long, sender string, recipient string, timestamp timestamp, is_phishing int"


def triggers(spark, folder, schema, batches):
    """A stream that brings each batch in a trigger of its own."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return stateful.state_session(spark).readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def hours(n):
    return START + dt.timedelta(hours=n)


def pairs(rows):
    return [(i, "s", "q" if i % 3 == 0 else None if i % 7 == 0 else "r", hours(7 * i), int(i == 20)) for i in rows]


def scores(df):
    return {r.id: (r.prior_n, r.prior_phishing, r.prior_gap_days, round(r.history_risk, 6)) for r in df.select("id", "prior_n", "prior_phishing", "prior_gap_days", "history_risk").collect()}


def test_pairs_from_history_with_late_rows(spark, tmp_path):
    """Rows that come a trigger late, within a day, count in their place; those beyond it count nowhere."""
    rows = pairs(range(90))
    known, coming = rows[:30], rows[30:]
    batches = [coming[k * 10:k * 10 + 10] for k in range(6)]
    late = batches[1].pop(8)  # 14 hours before the end of its batch
    batches[2].append(late)
    lost = batches[1].pop(0)  # nearly three days before it
    batches[3].append(lost)
    stream = triggers(spark, tmp_path, SCHEMA, batches)
    start = stateful.state_session(spark).createDataFrame(known, SCHEMA)
    out = monitors.run_to_table(stateful.pair_state(stream, start), f"{tmp_path}/work")
    seen = [r for r in rows if r != lost]
    closed = max(r[3] for r in seen) - dt.timedelta(days=1)
    batch = behavior.pair_history(spark.createDataFrame(seen, SCHEMA))
    want = {k: v for k, v in scores(batch).items() if 30 <= k and rows[k][3] <= closed}
    assert scores(out) == want and lost[0] not in want and late[0] in want
    count = {}
    for i, _, pair, when, _ in seen:
        count[i] = sum(1 for j, _, p, w, _ in seen if p == pair and w.hour == when.hour and (w, j) < (when, i))
    assert {r.id: r.hour_seen for r in out.collect()} == {k: count[k] for k in want}


def test_forgotten_pair(spark, tmp_path):
    rows = [(1, "a", "b", hours(0), 0), (2, "a", "b", hours(5), 0), (3, "a", "b", hours(24 * 30), 0), (4, "x", "y", hours(24 * 5), 0), (5, "x", "y", hours(24 * 20), 0), (6, "x", "y", hours(24 * 40), 0), (7, "x", "y", hours(24 * 50), 0)]
    order = [[rows[0]], [rows[1]], [rows[3]], [rows[4]], [rows[2]], [rows[5]], [rows[6]]]
    def n(ttl, place):
        stream = triggers(spark, tmp_path / place, SCHEMA, order)
        return {r.id: r.prior_n for r in monitors.run_to_table(stateful.pair_state(stream, ttl=ttl), f"{tmp_path}/{place}/work").collect()}
    assert n(None, "kept")[3] == 2
    assert n("10 days", "short")[3] == 0


def test_totals_of_hot_pairs(spark):
    rows = pairs(range(80))
    df = spark.createDataFrame(rows, SCHEMA)
    plain = {(r.sender, r.recipient): r[2:] for r in behavior.pair_totals(df).collect()}
    hot = {(r.sender, r.recipient): r[2:] for r in behavior.pair_totals(df, hot_rows=5).collect()}
    assert plain == hot
    own = [r for r in rows if r[2] == "q"]
    n, last, gaps, bad, seen = plain["s", "q"]
    assert (n, bad, sum(seen)) == (len(own), 0, len(own)) and gaps == sum((b[3] - a[3]).days for a, b in zip(own, own[1:]))


def test_once_per_interval_over_triggers(spark, tmp_path):
    draw = random.Random(2)
    when = sorted(draw.randrange(9000) for _ in range(400))
    rows = [(f"k{draw.randrange(4)}" if t % 50 else None, START + dt.timedelta(seconds=t)) for t in when] + [("k9", START), ("k9", START + dt.timedelta(seconds=299)), ("k9", START + dt.timedelta(seconds=301))]
    rows.sort(key=lambda r: r[1])
    batches = [rows[k * 60:k * 60 + 60] for k in range(7)]
    for b in batches:
        draw.shuffle(b)
    stream = triggers(spark, tmp_path, "k string, timestamp timestamp", batches)
    out = monitors.run_to_table(stateful.once_per_interval(stream, "k"), f"{tmp_path}/work").collect()
    want, last = set(), {}
    for key, at in rows:
        if key not in last or (at - last[key]).total_seconds() >= 300:
            want.add((key, at))
            last[key] = at
    assert sorted(map(str, ((r.k, r.timestamp) for r in out))) == sorted(map(str, want))
    assert [(r.timestamp - START).total_seconds() for r in out if r.k == "k9"] in ([0.0, 301.0], [301.0, 0.0])


def test_a_retried_trigger_changes_nothing(spark, data, tmp_path):
    tables = monitors.TriggerTables(spark, str(tmp_path))
    known = snapshots(spark, data)
    tables.start(known.history)
    ready = known.prepared()
    mail = view(spark, data, "mail").select("mail_id", "sender", "recipient", "sent_at", "raw").filter("mail_id < 40")
    one, two = mail.filter("mail_id < 20"), mail.filter("mail_id >= 20")

    def state():
        return {name: sorted(map(str, tables.read(name).collect())) for name in ("verdicts", "history", "pairs", "hours")}

    monitors.score_trigger(one, 0, tables, ready)
    first = state()
    monitors.score_trigger(one, 0, tables, ready)  # done: nothing is written
    assert state() == first

    class Broken(monitors.TriggerTables):
        def commit(self, trigger, mails):
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        monitors.score_trigger(two, 1, Broken(spark, str(tmp_path)), ready)
    assert state() == first  # written, but not in the ledger
    monitors.score_trigger(two, 1, tables, ready)
    done = state()
    monitors.score_trigger(two, 1, tables, ready)
    assert state() == done and len(done["verdicts"]) == 40
    # what the first trigger brought counts in the second, and only there
    pairs = {(r.sender, r.recipient): r.pair_n for r in tables.totals_before(1).pairs.collect()}
    base = {(r.sender, r.recipient): r.pair_n for r in behavior.pair_snapshot(known.history).collect()}
    added = {}
    for r in one.select("sender", "recipient").collect():
        added[r.sender, r.recipient] = added.get((r.sender, r.recipient), 0) + 1
    assert pairs == {k: base.get(k, 0) + added.get(k, 0) for k in base.keys() | added.keys()}


def test_a_join_keeps_one_store_a_partition(spark, tmp_path):
    """Both sides, an hour apart in triggers of their own; late feedback finds its detection in the state."""
    seen = triggers(spark, tmp_path / "d", "id long, timestamp timestamp, is_phishing boolean, confidence double", [[(i, hours(30 * k + i % 20), i % 2 == 0, 0.5) for i in range(20 * k, 20 * k + 20)] for k in range(3)])
    said = triggers(spark, tmp_path / "f", "detection_id long, timestamp timestamp, issue_type string", [[(i, hours(30 * k + i % 20 + i % 4), "Other") for i in range(20 * k, 20 * k + 20)] for k in range(3)])
    out = monitors.run_to_table(monitors.detections_with_feedback(seen, said), f"{tmp_path}/work")
    assert sorted(r.det_id for r in out.collect()) == [i for i in range(60) if i % 4 < 3]
    stores = {p.name for p in (tmp_path / "work/checkpoint/state/0/0").iterdir() if p.is_dir() and not p.name.startswith("_")}
    assert not any("keyTo" in name or "keyWith" in name for name in stores)


def test_a_large_slice_comes_in_more_files(spark, tmp_path, data, monkeypatch):
    monkeypatch.setattr(queries_streaming, "FILE_ROWS", 10)
    monkeypatch.setattr(queries_streaming, "folder", lambda spark: str(tmp_path))
    spark.range(900).selectExpr("id AS event_id", "timestamp'2024-01-01' + make_dt_interval(0, id) AS ts", "id % 7 AS user_id", "'click' AS event_type", "1.0 AS value").write.parquet(f"{tmp_path}/t/events.parquet")
    queries_streaming.arrivals(spark, f"{tmp_path}/t", queries_streaming.DETECTIONS)
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 9 * 10
    assert spark.read.parquet(f"{tmp_path}/in").select("id").distinct().count() == 900
