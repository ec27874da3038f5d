"""Monitoring queries over the detection and feedback tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailglass.functions.join import lookup_join
from mailglass.operators.senders import sender_facts


def total_scans(detections: DataFrame) -> DataFrame:
    return detections.agg(F.count("*").alias("total_scans"))


def phishing_detected(detections: DataFrame) -> DataFrame:
    return detections.filter("is_phishing").agg(F.count("*").alias("phishing_detected"))


def record_feedback(feedback: DataFrame) -> DataFrame:
    """Rows to append for user reports. ``is_correct`` is true exactly for a
    reported false negative; ``verdict_correct`` tells whether the detector was
    right, which a false positive or negative report denies."""
    return feedback.withColumns({
        "is_correct": F.col("issue_type") == "False Negative",
        "verdict_correct": ~F.col("issue_type").isin("False Positive", "False Negative")})


def false_positives(detections: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback rows that deny a phishing detection. Feedback is counted per
    detection before the join, so a much-reported detection is one row in it."""
    d = detections.filter("is_phishing").select(F.col("id").alias("detection_id"))
    denied = feedback.filter("NOT is_correct").groupBy("detection_id").agg(F.count("*").alias("n"))
    return denied.join(d, "detection_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("false_positives"))


def accuracy(feedback: DataFrame) -> DataFrame:
    """Share of feedback marked correct in percent, 0 without feedback."""
    return feedback.agg(F.coalesce(F.try_divide(F.count_if("is_correct") * 100.0, F.count("*")), F.lit(0.0)).alias("accuracy_percent"))


def detections_per_day(detections: DataFrame, days: int = 7) -> DataFrame:
    """Counts of the latest days that have any detection."""
    return (detections.groupBy(F.to_date("timestamp").alias("day")).agg(F.count("*").alias("n"))
            .orderBy(F.desc("day")).limit(days))


def confidence_histogram(detections: DataFrame, as_of: Column, days: int = 7, bins: int = 20) -> DataFrame:
    """Equal-width bins between the smallest and largest confidence of the
    last ``days`` days; the last bin includes its upper end."""
    recent = detections.filter(F.col("timestamp") >= F.date_sub(F.to_date(as_of), days)).select("confidence")
    lo, hi = recent.agg(F.min("confidence"), F.max("confidence")).first()
    cell = (F.least(F.floor((F.col("confidence") - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
            if lo is not None and hi > lo else F.lit(0))
    return recent.groupBy(cell.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def feedback_history(detections: DataFrame, feedback: DataFrame, rows: int = 100) -> DataFrame:
    """Latest feedback with the issue type the detection implies."""
    d = detections.select(F.col("id").alias("detection_id"), "is_phishing")
    df = lookup_join(feedback, d, ["detection_id"], spread_by="id", true_size=True).filter("is_phishing IS NOT NULL").select(
        "timestamp", "detection_id",
        F.when(F.col("is_phishing") == F.col("is_correct"), "False Negative").otherwise("False Positive").alias("issue_type"),
        F.lit("Submitted").alias("status"))
    return df.orderBy(F.desc("timestamp"), F.desc("detection_id")).limit(rows)


MESSAGE = T.StructType([
    T.StructField("email_id", T.StringType()), T.StructField("email_content", T.StringType()), T.StructField("is_phishing", T.BooleanType()),
    T.StructField("email_data", T.StructType([
        T.StructField("subject", T.StringType()), T.StructField("sender", T.StringType()), T.StructField("confidence", T.DoubleType())])),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])


def flatten_feedback(messages: DataFrame, column: str = "value") -> DataFrame:
    """JSON feedback messages as flat rows with the derived verdict and context.
    The user's verdict is the opposite of the reported one."""
    df = messages.withColumn("_m", F.from_json(F.col(column), MESSAGE))
    m = F.col("_m")
    shown = F.coalesce(m["is_phishing"], F.lit(False))
    df = df.select(
        *[c for c in messages.columns if c != column],
        m["email_id"].alias("email_id"), F.coalesce(m["email_content"], F.lit("")).alias("email_content"), shown.alias("original_verdict"),
        (~shown).alias("user_verdict"), F.coalesce(m["email_data"]["subject"], F.lit("")).alias("subject"),
        F.coalesce(m["email_data"]["sender"], F.lit("")).alias("sender"), F.coalesce(m["email_data"]["confidence"], F.lit(0.0)).alias("confidence"),
        F.when(shown, "false_positive").otherwise("false_negative").alias("reported_as"), m["metadata"].alias("metadata"))
    df = df.withColumn("domain", F.split_part("sender", F.lit("@"), F.lit(2)))
    facts = sender_facts(df)
    known = F.col("sender") != ""
    return facts.withColumns({
        "is_known_sender": known & F.col("is_known_sender"), "is_business_domain": known & F.col("is_business_domain"),
        "sender_category": F.when(known, F.col("sender_category")).otherwise("unknown")})
