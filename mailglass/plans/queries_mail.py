"""Queries over the mail table: headers, body, text (P rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailglass import rules
from mailglass.operators import mail as ops
from mailglass.plans.bindings import view
from mailglass.plans.oracle_base import HEADER_FROM, build, decoded, header, lit
from mailglass.plans.registry import joined, query


@query("p1_headers", build(
    f"SELECT mail_id, {HEADER_FROM} AS header_from, {decoded(header('To'))} AS header_to, "
    f"{decoded(header('Subject'))} AS header_subject, {header('Date')} AS header_date FROM hdr", "hdr"))
def p1(spark, sf_dir):
    return ops.extract_headers(view(spark, sf_dir, "mail")).select(
        "mail_id", "header_from", "header_to", "header_subject", "header_date")


@query("p2_first_header_line", build(
    "SELECT mail_id, trim(substr(list_filter(string_split(raw, chr(10)), lambda x: starts_with(x, 'From:'))[1], 6)) AS from_line, "
    "trim(substr(list_filter(string_split(raw, chr(10)), lambda x: starts_with(x, 'To:'))[1], 4)) AS to_line FROM hdr", "hdr"))
def p2(spark, sf_dir):
    df = ops.first_header_line(view(spark, sf_dir, "mail"), "From:", "from_line")
    return ops.first_header_line(df, "To:", "to_line").select("mail_id", "from_line", "to_line")


@query("p3_split_parts", build(
    f"SELECT mail_id, head AS headers, coalesce({decoded(header('Subject'))}, '') AS part_subject, trim(body) AS part_body FROM hdr", "hdr"))
def p3(spark, sf_dir):
    return ops.split_parts(view(spark, sf_dir, "mail")).select("mail_id", "headers", "part_subject", "part_body")


@query("p4_strip_markup", build(
    r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM html", "html"))
def p4(spark, sf_dir):
    return view(spark, sf_dir, "html").select("page_id", ops.strip_markup(F.col("html")).alias("body"))


_SUBJECT = "CASE WHEN id % 3 = 0 THEN NULL ELSE concat('about ', source) END"
_BODY = "CASE WHEN id % 5 = 0 THEN NULL ELSE body END"


@query("p5_model_text", build(
    f"SELECT id, CASE WHEN s IS NOT NULL AND b IS NOT NULL THEN s || chr(10) || chr(10) || b ELSE coalesce(b, s, '') END AS text, "
    "'Subject: ' || coalesce(s, '') || chr(10) || CASE WHEN id % 2 = 0 THEN 'Content-Type: text/html; charset=UTF-8' || chr(10) ELSE '' END || chr(10) || coalesce(b, '') AS content "
    f"FROM (SELECT id, {_SUBJECT} AS s, {_BODY} AS b FROM corpus)", "corpus"))
def p5(spark, sf_dir):
    df = view(spark, sf_dir, "corpus").selectExpr("id", f"{_SUBJECT} AS subject", f"{_BODY} AS body", "id % 2 = 0 AS html")
    df = ops.model_text(df).withColumn("body", F.coalesce("body", F.lit("")))
    return ops.format_for_scoring(df, "subject", "body", "html").select("id", "text", "content")


_LABEL = "CASE id % 6 WHEN 0 THEN 'spam' WHEN 1 THEN 'ham' WHEN 2 THEN 'phish' WHEN 3 THEN 'OK' WHEN 4 THEN 'phishing' ELSE 'other' END"
_NAMED = "CASE label " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in rules.LABEL_NAMES.items()) + " END"


@query("p6_labels", build(
    "SELECT id, label, label_name, CAST(CASE coalesce(label_name, label) WHEN 'phishing' THEN 1 ELSE 0 END AS INTEGER) AS label_number "
    f"FROM (SELECT id, label, {_NAMED} AS label_name FROM (SELECT id, {_LABEL} AS label FROM corpus))", "corpus"))
def p6(spark, sf_dir):
    df = view(spark, sf_dir, "corpus").selectExpr("id", f"{_LABEL} AS label")
    return ops.normalize_labels(df).select("id", "label", "label_name", "label_number")


@query("p7_header_metadata", build(
    "SELECT mail_id, date_text, zone, strftime(local_ts, '%Y-%m-%d') AS local_date, strftime(local_ts, '%H:%M:%S') AS local_time, "
    "CAST(extract('hour' FROM local_ts) AS INTEGER) AS local_hour, CAST(isodow(local_ts) - 1 AS INTEGER) AS local_weekday, "
    "CAST(epoch(local_ts) - (CASE WHEN zone[1] = '-' THEN -1 ELSE 1 END) * (CAST(zone[2:3] AS BIGINT) * 3600 + CAST(zone[4:5] AS BIGINT) * 60) AS BIGINT) AS sent_epoch, "
    "CAST(len(received_domains) AS INTEGER) AS received_count, array_to_string(received_domains, ' | ') AS received_domains, "
    "array_to_string(received_ips, ' | ') AS received_ips, origin_ip, return_path, reply_to, x_mailer FROM meta", "meta"))
def p7(spark, sf_dir):
    df = ops.header_metadata(view(spark, sf_dir, "mail"))
    return df.select(
        "mail_id", "date_text", "zone", "local_date", "local_time", "local_hour", "local_weekday",
        F.unix_timestamp("sent_utc").alias("sent_epoch"), "received_count",
        joined("received_domains").alias("received_domains"), joined("received_ips").alias("received_ips"),
        "origin_ip", "return_path", "reply_to", "x_mailer")


@query("p8_preview", "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview FROM documents")
def p8(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", ops.preview(F.col("text")).alias("preview"))


# every 7th sender score, every 11th link score ... is missing, as after a failed lookup
_GAPPY = ("id, CASE WHEN id % 7 = 0 THEN NULL ELSE nb END AS sender_score, CASE WHEN id % 11 = 0 THEN NULL ELSE rf END AS url_score, "
          "CASE WHEN id % 13 = 0 THEN NULL ELSE lr END AS behavior_score, CASE WHEN id % 3 = 0 THEN NULL ELSE nb END AS image_score, "
          "CASE WHEN id % 17 = 0 THEN 'unreadable' END AS error")


@query("p9_component_defaults", build(
    "SELECT id, CAST(coalesce(sender_score, 0.5) AS DOUBLE) AS sender_score, CAST(coalesce(url_score, 0.5) AS DOUBLE) AS url_score, "
    "CAST(coalesce(behavior_score, 0.5) AS DOUBLE) AS behavior_score, CAST(coalesce(image_score, 0.0) AS DOUBLE) AS image_score "
    f"FROM (SELECT {_GAPPY} FROM prob) WHERE error IS NULL", "prob"))
def p9(spark, sf_dir):
    df = view(spark, sf_dir, "prob").selectExpr(*_split(_GAPPY))
    good, _ = ops.quarantine(df, F.col("error").isNotNull())
    return ops.with_component_defaults(good, {
        "sender": "sender_score", "url": "url_score", "behavioral": "behavior_score", "image": "image_score"}).drop("error")


def _split(items: str) -> list[str]:
    return [item.strip() for item in items.split(", CASE")[:1]] + ["CASE" + item for item in items.split(", CASE")[1:]]


@query("p10_visible_images", build(
    "SELECT image_id, mail_id, width, height FROM images WHERE width >= 20 AND height >= 20", "images"))
def p10(spark, sf_dir):
    return ops.drop_tiny_images(view(spark, sf_dir, "images")).select("image_id", "mail_id", "width", "height")
