"""Streaming queries (T rows): file source, everything available now, parquet
sink, result read back. The check SQL is the batch twin."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from mailglass.operators.similarity import centroids
from mailglass.plans.bindings import DETECTIONS, FEEDBACK, HISTORY, view
from mailglass.plans.oracle_base import BLOCKS, block, build, d
from mailglass.plans.queries_similarity import questions
from mailglass.plans.queries_verdict import snapshots
from mailglass.plans.registry import query, r6
from mailglass.session import materialize, shared_folder
from mailglass.streaming import monitors, stateful
from mailglass.streaming.stateful import state_session


# Events come in nine time slices, one a trigger. A few of the last twelve hours of a slice come with
# the next one, within what the watermark allows; a few come three slices late, beyond it.
SLICES, FILES = 9, 4
FILE_ROWS = 250_000  # a larger slice comes in more files, so that its trigger is read by more tasks
block("ends", "SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events")
_ARRIVES = """
SELECT *, CASE WHEN id % 97 = 3 AND slice <= 5 THEN slice + 3 WHEN id % 11 = 0 AND slice < 8 AND (slice + 1) * width - since <= 43200000000 THEN slice + 1 ELSE slice END AS arrival,
  id % 97 = 3 AND slice <= 5 AS too_late
FROM (SELECT *, CAST(least(floor(since / CAST(width AS DOUBLE)), 8) AS INT) AS slice FROM (SELECT s.*, {us} - e.lo AS since, CAST(floor((e.hi - e.lo) / CAST(9 AS DOUBLE)) + 1 AS BIGINT) AS width FROM {table} s, ends e) a) b"""
block("arriving", _ARRIVES.format(table="detections", us="epoch_us(timestamp)"), "detections", "ends")
block("arriving_history", _ARRIVES.format(table="history", us="epoch_us(timestamp)"), "history", "ends")
# the watermark below which a trigger's rows are late: the latest time of the triggers before the one before, minus a day
block("marks", "SELECT a AS arrival, (SELECT max(timestamp) FROM arriving WHERE arrival < a - 1) - INTERVAL '1' DAY AS mark FROM (SELECT unnest(range(9)) AS a)", "arriving")


def arrivals(spark, sf_dir, text: str, first: int = 0, on_time: bool = False):
    """A portable view's rows from slice ``first`` on as a stream, a slice a trigger, and
    those before it as a frame. ``on_time`` leaves out what is late."""
    spread = spark.sql(text.replace("FROM events", f"FROM parquet.`{sf_dir}/events.parquet`"))
    spread.createOrReplaceTempView("events_spread")
    ends = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.unix_micros(F.min(F.col("ts").cast("timestamp"))).alias("lo"), F.unix_micros(F.max(F.col("ts").cast("timestamp"))).alias("hi"))
    ends.createOrReplaceTempView("ends")
    rows = materialize(spark.sql(_ARRIVES.format(table="events_spread", us="unix_micros(CAST(timestamp AS TIMESTAMP))")).withColumn("timestamp", F.col("timestamp").cast("timestamp")))
    names = spread.columns
    place = folder(spark)
    when = "slice" if on_time else "arrival"
    files = max(FILES, rows.count() // (SLICES * FILE_ROWS))
    for k in range(first, SLICES):
        (rows.filter((F.col(when) == k) & (F.col("slice") >= first)).select(*names).repartition(files).write.mode("append").parquet(f"{place}/in"))
    source = state_session(spark).readStream.schema(rows.select(*names).schema).option("maxFilesPerTrigger", files).parquet(f"{place}/in")
    return source, rows.filter(F.col("slice") < first).select(*names)


def run(spark, stream):
    """The stream's whole output, read by the caller's session."""
    place = folder(spark)
    schema = monitors.run_to_table(stream, place).schema
    return spark.read.schema(schema).parquet(f"{place}/out")


def folder(spark):
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


_RISK = "CASE WHEN n = 0 THEN {0} WHEN p > 0 THEN {1} ELSE greatest({2}, {3} - {2} * least(n, 4)) END".format(d(0.6), d(0.9), d(0.1), d(0.5))


# the first three slices are the history that the state starts from; rows beyond the last watermark still wait
@query("t1_pair_state", build(f"""
SELECT id, sender, recipient, n AS prior_n, CAST(p AS INTEGER) AS prior_phishing, CAST(g AS BIGINT) AS prior_gap_days, hs AS hour_seen, round({_RISK}, 6) AS history_risk
FROM (SELECT *, count(*) OVER w AS n, coalesce(max(is_phishing) OVER w, 0) AS p, coalesce(sum(gap) OVER w, 0) AS g,
    count(*) OVER (PARTITION BY sender, recipient, extract('hour' FROM timestamp) ORDER BY timestamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hs
  FROM (SELECT *, floor((epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY sender, recipient ORDER BY timestamp, id))) / 86400000000) AS gap FROM arriving_history WHERE slice < 3 OR NOT too_late)
  WINDOW w AS (PARTITION BY sender, recipient ORDER BY timestamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WHERE slice >= 3 AND timestamp <= (SELECT max(timestamp) - INTERVAL '1' DAY FROM history)""", "arriving_history"))
def t1(spark, sf_dir):
    source, before = arrivals(spark, sf_dir, HISTORY, 3)
    df = run(spark, stateful.pair_state(source, state_session(spark).read.schema(before.schema).parquet(written(before))))
    return df.withColumn("history_risk", r6("history_risk"))


def written(df):
    place = f"{folder(df.sparkSession)}/start"
    df.write.parquet(place)
    return place


# append mode gives windows that the watermark (latest time minus a day) has closed;
# a row counts in the windows that the watermark of its trigger has not closed
_CLOSED = "(SELECT max(timestamp) - INTERVAL '1' DAY FROM detections)"


@query("t2_daily_counts", build(
    "SELECT CAST(epoch(date_trunc('day', timestamp)) AS BIGINT) AS day, count(*) AS n, count(*) FILTER (WHERE is_phishing) AS phishing FROM arriving JOIN marks USING (arrival) "
    "WHERE mark IS NULL OR date_trunc('day', timestamp) + INTERVAL '1' DAY > mark "
    f"GROUP BY date_trunc('day', timestamp) HAVING date_trunc('day', timestamp) + INTERVAL '1' DAY <= {_CLOSED}", "arriving", "marks"))
def t2(spark, sf_dir):
    df = run(spark, monitors.daily_detections(arrivals(spark, sf_dir, DETECTIONS)[0]))
    return df.withColumn("day", F.unix_timestamp("day"))


@query("t3_weekly_rates", build(
    "SELECT CAST(epoch(s) AS BIGINT) AS start, count(*) AS n, round(avg(CASE WHEN is_phishing THEN 1.0 ELSE 0.0 END), 6) AS phishing_rate, round(avg(confidence), 6) AS mean_confidence "
    "FROM (SELECT *, date_trunc('day', timestamp) - k * INTERVAL '1' DAY AS s FROM arriving JOIN marks USING (arrival), (SELECT unnest(range(7)) AS k)) "
    f"WHERE mark IS NULL OR s + INTERVAL '7' DAY > mark GROUP BY s HAVING s + INTERVAL '7' DAY <= {_CLOSED}", "arriving", "marks"))
def t3(spark, sf_dir):
    df = run(spark, monitors.weekly_rates(arrivals(spark, sf_dir, DETECTIONS)[0]))
    return df.select(F.unix_timestamp("start").alias("start"), "n", r6("phishing_rate").alias("phishing_rate"), r6("mean_confidence").alias("mean_confidence"))


block("emitted", """
SELECT email_from, min(timestamp) AS seen FROM detections GROUP BY email_from
UNION ALL SELECT e.email_from, (SELECT min(x.timestamp) FROM detections x WHERE x.email_from = e.email_from AND x.timestamp >= e.seen + INTERVAL '2' HOUR) FROM emitted e WHERE e.seen IS NOT NULL""", "detections")
block("emitted_5min", """
SELECT email_from, min(timestamp) AS seen FROM detections GROUP BY email_from
UNION ALL SELECT e.email_from, (SELECT min(x.timestamp) FROM detections x WHERE x.email_from = e.email_from AND x.timestamp >= e.seen + INTERVAL '300' SECOND) FROM emitted_5min e WHERE e.seen IS NOT NULL""", "detections")


# from the last emission on, five minutes and, as most senders are seen less often, two hours
@query("t4_once_per_interval", build(
    "SELECT email_from, epoch_us(seen) AS seen, '300 seconds' AS every FROM emitted_5min WHERE seen IS NOT NULL UNION ALL SELECT email_from, epoch_us(seen), '2 hours' FROM emitted WHERE seen IS NOT NULL", "emitted", "emitted_5min"))
def t4(spark, sf_dir):
    source = arrivals(spark, sf_dir, DETECTIONS, on_time=True)[0]
    both = [run(spark, stateful.once_per_interval(source, "email_from", interval=every)).select("email_from", F.unix_micros("timestamp").alias("seen"), F.lit(every).alias("every"))
            for every in ("300 seconds", "2 hours")]
    return both[0].unionByName(both[1])


@query("t5_detection_feedback_join", build(
    "SELECT d.id AS det_id, d.is_phishing, round(d.confidence, 6) AS confidence, f.issue_type FROM arriving d JOIN feedback f ON f.detection_id = d.id "
    "AND f.timestamp >= d.timestamp AND f.timestamp <= d.timestamp + INTERVAL '2' HOUR WHERE NOT d.too_late", "arriving", "feedback"))
def t5(spark, sf_dir):
    pair = monitors.detections_with_feedback(arrivals(spark, sf_dir, DETECTIONS)[0], arrivals(spark, sf_dir, FEEDBACK, on_time=True)[0])
    df = run(spark, pair)
    return df.select("det_id", "is_phishing", r6("confidence").alias("confidence"), "issue_type")


# mails come in five triggers; each is scored on the history and the mails of earlier triggers
TRIGGERS = 5
_EARLIER = f"SELECT *, mail_id % {TRIGGERS} AS arrival FROM mail"
_T6 = {
    "hours": (("history", "mail"), f"""SELECT sender, extract('hour' FROM timestamp) AS hour, -1 AS arrival, count(*) AS n FROM history GROUP BY ALL
UNION ALL SELECT sender, extract('hour' FROM sent_at), arrival, count(*) FROM ({_EARLIER}) GROUP BY ALL"""),
    "time_risk": (("meta", "hours"), BLOCKS["time_risk"][1].replace("m.sender IN (SELECT sender FROM hours)", "s.known").replace(
        "LEFT JOIN hours h ON h.sender = m.sender AND h.hour = m.hr",
        f"LEFT JOIN (SELECT x.mail_id, sum(y.n) AS n FROM meta x JOIN hours y ON y.sender = x.sender AND y.hour = extract('hour' FROM x.local_ts) AND y.arrival < x.mail_id % {TRIGGERS} GROUP BY x.mail_id) h ON h.mail_id = m.mail_id "
        f"LEFT JOIN (SELECT x.mail_id, count(y.sender) > 0 AS known FROM meta x LEFT JOIN hours y ON y.sender = x.sender AND y.arrival < x.mail_id % {TRIGGERS} GROUP BY x.mail_id) s ON s.mail_id = m.mail_id")),
    "behavior": (("mail", "time_risk", "geo", "consist", "history"), BLOCKS["behavior"][1].replace(
        "LEFT JOIN\n   (SELECT sender, recipient, count(*) AS n, max(is_phishing) AS p FROM history GROUP BY ALL) p ON p.sender = m.sender AND p.recipient = m.recipient",
        f"""LEFT JOIN (SELECT x.mail_id, sum(y.n) AS n, max(y.p) AS p FROM mail x JOIN (
     SELECT sender, recipient, -1 AS arrival, count(*) AS n, max(is_phishing) AS p FROM history GROUP BY ALL UNION ALL SELECT sender, recipient, arrival, count(*), 0 FROM ({_EARLIER}) GROUP BY ALL) y
     ON y.sender = x.sender AND y.recipient = x.recipient AND y.arrival < x.mail_id % {TRIGGERS} GROUP BY x.mail_id) p ON p.mail_id = m.mail_id""")),
    "votes": (("ask", "cents"), BLOCKS["votes"][1].replace("CAST(v.embedding AS DOUBLE[])", "v.embedding").replace("FROM vectors v", "FROM ask v")),
}


@query("t6_score_new_mails", build(
    "SELECT mail_id, is_phishing, round(confidence, 6) AS confidence, risk_level, round(behavior_risk, 6) AS behavior_risk, similar_mails FROM flag", "flag", using=_T6))
def t6(spark, sf_dir):
    place = folder(spark)
    mail = view(spark, sf_dir, "mail").select("mail_id", "sender", "recipient", "sent_at", "raw")
    mail = materialize(mail.join(questions(spark, sf_dir).select(F.col("id").alias("mail_id"), "embedding"), "mail_id", "left"))
    for k in range(TRIGGERS):
        mail.filter(F.col("mail_id") % TRIGGERS == k).repartition(FILES).write.mode("append").parquet(f"{place}/inbox")
    arriving = spark.readStream.schema(mail.schema).option("maxFilesPerTrigger", FILES).parquet(f"{place}/inbox")
    known = view(spark, sf_dir, "vectors")
    tables = replace(snapshots(spark, sf_dir), neighbours=None, votes=None, vectors=known.select("id", "embedding"), examples=centroids(known))
    monitors.score_stream(arriving, tables, f"{place}/out", f"{place}/checkpoint").awaitTermination()
    return monitors.TriggerTables(spark, f"{place}/out").read("verdicts").select(
        "mail_id", "is_phishing", r6("confidence").alias("confidence"), "risk_level", r6("behavior_risk").alias("behavior_risk"), "similar_mails")
