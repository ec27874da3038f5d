"""Monitoring queries (K rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailglass.operators import monitor as ops
from mailglass.plans.bindings import view
from mailglass.plans.oracle_base import block, build
from mailglass.plans.queries_senders import FACTS
from mailglass.plans.registry import query, r6

block("told", "SELECT *, issue_type = 'False Negative' AS is_correct, issue_type NOT IN ('False Positive', 'False Negative') AS verdict_correct FROM feedback", "feedback")


def told(spark, sf_dir):
    return ops.record_feedback(view(spark, sf_dir, "feedback"))


@query("k1_total_scans", build("SELECT count(*) AS total_scans FROM detections", "detections"))
def k1(spark, sf_dir):
    return ops.total_scans(view(spark, sf_dir, "detections"))


@query("k2_phishing_detected", build("SELECT count(*) AS phishing_detected FROM detections WHERE is_phishing", "detections"))
def k2(spark, sf_dir):
    return ops.phishing_detected(view(spark, sf_dir, "detections"))


@query("k3_false_positives", build(
    "SELECT count(*) AS false_positives FROM detections d JOIN told f ON d.id = f.detection_id WHERE d.is_phishing AND NOT f.is_correct", "detections", "told"))
def k3(spark, sf_dir):
    return ops.false_positives(view(spark, sf_dir, "detections"), told(spark, sf_dir))


@query("k4_accuracy", build(
    "SELECT round(CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (WHERE is_correct) AS DOUBLE) / count(*) * 100 ELSE 0 END, 6) AS accuracy_percent FROM told", "told"))
def k4(spark, sf_dir):
    return ops.accuracy(told(spark, sf_dir)).select(r6("accuracy_percent").alias("accuracy_percent"))


@query("k5_detections_per_day", build(
    "SELECT CAST(timestamp AS DATE) AS day, count(*) AS n FROM detections GROUP BY 1 ORDER BY day DESC LIMIT 7", "detections"))
def k5(spark, sf_dir):
    return ops.detections_per_day(view(spark, sf_dir, "detections"))


_NOW = "TIMESTAMP '2024-01-30 12:00:00'"


@query("k6_confidence_histogram", build(
    "SELECT CAST(least(floor((confidence - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM (SELECT confidence, min(confidence) OVER () AS lo, max(confidence) OVER () AS hi "
    f"FROM detections WHERE timestamp >= CAST({_NOW} AS DATE) - 7) GROUP BY 1", "detections"))
def k6(spark, sf_dir):
    return ops.confidence_histogram(view(spark, sf_dir, "detections"), F.expr(_NOW))


@query("k7_feedback_history", build(
    "SELECT f.timestamp, f.detection_id, CASE WHEN d.is_phishing = f.is_correct THEN 'False Negative' ELSE 'False Positive' END AS issue_type, 'Submitted' AS status "
    "FROM told f JOIN detections d ON f.detection_id = d.id ORDER BY f.timestamp DESC, f.detection_id DESC LIMIT 100", "told", "detections"))
def k7(spark, sf_dir):
    return ops.feedback_history(view(spark, sf_dir, "detections"), told(spark, sf_dir))


@query("k8_record_feedback", build("SELECT id, detection_id, issue_type, is_correct, verdict_correct FROM told", "told"))
def k8(spark, sf_dir):
    return told(spark, sf_dir).select("id", "detection_id", "issue_type", "is_correct", "verdict_correct")


# messages as a client sends them; some lack the sender or the content
_JSON = """concat('{"email_id": "m', CAST(mail_id AS STRING), '", ', CASE WHEN mail_id % 4 = 1 THEN '' ELSE concat('"email_content": "', phrase, '", ') END,
  '"is_phishing": ', CASE WHEN mail_id % 3 = 0 THEN 'true' ELSE 'false' END, ', "email_data": {"subject": "', subject, '"', CASE WHEN mail_id % 5 = 2 THEN '' ELSE concat(', "sender": "', sender, '"') END,
  ', "confidence": ', CAST(mail_id % 100 AS STRING), '}, "metadata": {"client": "v', CAST(mail_id % 3 AS STRING), '"}}')"""


@query("k9_flatten_feedback", build(f"""
SELECT email_id, CASE WHEN mail_id % 4 = 1 THEN '' ELSE phrase END AS email_content, shown AS original_verdict, NOT shown AS user_verdict, subject, sender,
  CAST(mail_id % 100 AS DOUBLE) AS confidence, CASE WHEN shown THEN 'false_positive' ELSE 'false_negative' END AS reported_as, domain, 'v' || mail_id % 3 AS client,
  sender <> '' AND is_known_sender AS is_known_sender, sender <> '' AND is_business_domain AS is_business_domain, CASE WHEN sender <> '' THEN sender_category ELSE 'unknown' END AS sender_category, email_type
FROM (SELECT *, {FACTS} FROM (SELECT mail_id, 'm' || mail_id AS email_id, phrase, subject, mail_id % 3 = 0 AS shown, CASE WHEN mail_id % 5 = 2 THEN '' ELSE sender END AS sender,
  CASE WHEN mail_id % 5 = 2 THEN '' ELSE domain END AS domain FROM mail))""", "mail"))
def k9(spark, sf_dir):
    messages = view(spark, sf_dir, "mail").select(F.expr(_JSON).alias("value"))
    return ops.flatten_feedback(messages).withColumn("client", F.col("metadata")["client"]).drop("metadata")
