"""Source and sink round trips (S rows) and MIME bodies. Each query writes a
whole driver table in the format under test and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mailglass.operators import corpus
from mailglass.plans.bindings import view
from mailglass.plans.oracle_base import build
from mailglass.plans.registry import query, r6
from mailglass.session import shared_folder
from mailglass.sources import mime, readers, writers


def scratch(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_STRIP = r"trim(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query("p4_mime_bodies", build(f"SELECT mail_id, {_STRIP.format('body')} AS body FROM hdr", "hdr"))
def p4_mime(spark, sf_dir):
    return mime.mime_bodies(view(spark, sf_dir, "mail")).select("mail_id", "body")


def _named(key):
    return F.concat(F.lit(f"{key}="), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(".txt"))


def _name_of(key):
    return F.nullif(F.regexp_extract("path", rf"/{key}=(-?\d*)\.txt$", 1), F.lit("")).cast("long").alias(key)


@query("s1_mail_files", build("SELECT mail_id, raw FROM mail", "mail"))
def s1(spark, sf_dir):
    folder = scratch(spark, "eml")
    mail = view(spark, sf_dir, "mail")
    # one file per mail, named by its id
    writers.write_files(mail, folder, _named("mail_id"), F.col("raw"))
    files = readers.read_mail_files(spark, folder, "*.txt")
    return files.select(_name_of("mail_id"), F.regexp_replace("raw", r"\n\z", "").alias("raw"))


@query("s2_mbox", build("SELECT raw FROM mail", "mail"))
def s2(spark, sf_dir):
    folder = scratch(spark, "mbox")
    mail = view(spark, sf_dir, "mail")
    escaped = F.regexp_replace("raw", r"(?m)^(>*From )", ">$1")
    mail.select(F.concat(F.lit("From "), "sender", F.lit(" Mon Jan  1 00:00:00 2024\n"), escaped, F.lit("\n")).alias("value")).write.text(folder)
    return readers.read_mbox(spark, folder).select(F.regexp_replace("raw", r"\n+\z", "").alias("raw"))


@query("s3_labelled_folders", build("SELECT id, CASE is_phishing WHEN 1 THEN 'phishing' ELSE 'legitimate' END AS label, CAST(octet_length(encode(body)) AS BIGINT) AS n_chars FROM corpus", "corpus"))
def s3(spark, sf_dir):
    folder = scratch(spark, "folders")
    box = F.when(F.col("is_phishing") == 1, "box=spam/").otherwise("box=ham/")
    writers.write_files(view(spark, sf_dir, "corpus"), folder, F.concat(box, _named("id")), F.col("body"))
    files = readers.read_labelled_folders(spark, folder, {"box=spam": "phishing", "box=ham": "legitimate"})
    # read as Latin-1, a text has as many characters as it has bytes
    files = files.withColumn("raw", F.regexp_replace("raw", r"\n\z", ""))
    return files.select(_name_of("id"), "label", F.length("raw").cast("long").alias("n_chars"))


@query("s4_labelled_csv", build("SELECT body AS text, CASE is_phishing WHEN 1 THEN 'phishing' ELSE 'legitimate' END AS label FROM corpus", "corpus"))
def s4(spark, sf_dir):
    folder = scratch(spark, "csv")
    df = view(spark, sf_dir, "corpus").select(F.col("body").alias("text"), F.when(F.col("is_phishing") == 1, "phishing").otherwise("legitimate").alias("label"))
    df.write.option("header", "true").option("quoteAll", "true").option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option(
        "ignoreTrailingWhiteSpace", "false").csv(folder)
    return readers.read_labelled_csv(spark, folder)


@query("s5_canonical_columns", build(
    "SELECT CAST(source AS VARCHAR) AS subject, '' AS sender, 'r' || id AS recipient, '' AS date, coalesce(nullif(CASE WHEN id % 9 = 0 THEN '' ELSE body END, ''), CAST(id AS VARCHAR)) AS body, "
    "CAST(CASE WHEN id % 4 = 0 THEN 1 ELSE is_phishing END AS INTEGER) AS is_phishing FROM corpus", "corpus"))
def s5(spark, sf_dir):
    df = view(spark, sf_dir, "corpus").select(
        F.col("id").alias("Nr"), F.col("lang").alias("old_text"), F.when(F.col("id") % 9 == 0, "").otherwise(F.col("body")).alias("Message Body"),
        F.when(F.col("id") % 4 != 0, F.col("is_phishing")).alias("Class"), F.col("source").alias("Subject line"), F.concat(F.lit("r"), "id").alias("Delivered-To"))
    return readers.to_canonical(df, is_phishing=True)


@query("s6_reputation_csv", build("SELECT domain, reputation_score, blacklisted, blacklist_count, sources FROM (SELECT lower(source) || '.example.com' AS domain, "
       "CAST(count(*) % 10 AS DOUBLE) / 10 AS reputation_score, max(is_phishing) = 1 AS blacklisted, CAST(sum(is_phishing) AS INTEGER) AS blacklist_count, 'corpus,labels' AS sources FROM corpus GROUP BY source)", "corpus"))
def s6(spark, sf_dir):
    folder = scratch(spark, "reputation")
    df = view(spark, sf_dir, "corpus").groupBy("source").agg(
        ((F.count("*") % 10).cast("double") / 10).alias("reputation_score"), (F.max("is_phishing") == 1).alias("blacklisted"),
        F.sum("is_phishing").cast("int").alias("blacklist_count"))
    df.select(F.concat(F.lower("source"), F.lit(".example.com")).alias("domain"), "reputation_score", "blacklisted", "blacklist_count",
              F.lit("corpus,labels").alias("sources")).write.option("header", "true").csv(folder)
    return readers.read_reputation(spark, folder).drop("ord")


@query("s7_history", build("SELECT sender, recipient, CAST(epoch_us(timestamp) AS BIGINT) AS us, is_phishing, CAST(NULL AS VARCHAR) AS origin_country FROM history", "history"))
def s7(spark, sf_dir):
    folder = scratch(spark, "history")
    history = view(spark, sf_dir, "history").select("sender", "recipient", F.col("timestamp").cast("timestamp").alias("timestamp"), "is_phishing")
    # two appends, as two scoring runs would leave them
    writers.append_history(history.filter("is_phishing = 0"), folder)
    writers.append_history(history.filter("is_phishing = 1"), folder)
    return readers.read_history(spark, folder, "parquet").select("sender", "recipient", F.unix_micros("timestamp").alias("us"), "is_phishing", "origin_country")


@query("s8_examples_json", build("SELECT body AS content, is_phishing = 1 AS is_phishing, 'from ' || source AS explanation FROM corpus", "corpus"))
def s8(spark, sf_dir):
    folder = scratch(spark, "examples")
    rows = view(spark, sf_dir, "corpus").select("id", F.struct(
        F.col("body").alias("content"), (F.col("is_phishing") == 1).alias("is_phishing"), F.concat(F.lit("from "), "source").alias("explanation")).alias("e"))
    # nested documents over many lines, a file each; their number grows with the table
    docs = rows.groupBy(F.floor(F.col("id") / 500).alias("doc")).agg(F.collect_list("e").alias("examples"))
    docs.select("doc", F.to_json(F.struct("examples"), {"pretty": "true"})).repartition("doc").write.partitionBy("doc").text(folder)
    return readers.read_examples(spark, folder)


@query("s9_vector_table", build("SELECT id, is_phishing, 'label' || label AS kind, len(embedding) AS dims, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value FROM vectors", "vectors"))
def s9(spark, sf_dir):
    folder = scratch(spark, "vectors")
    table = view(spark, sf_dir, "vectors").withColumn("metadata", F.create_map(F.lit("type"), F.concat(F.lit("label"), "label")))
    writers.save_vectors(table, folder)
    return readers.read_vectors(spark, folder).select("id", "is_phishing", F.col("metadata")["type"].alias("kind"), F.size("embedding").cast("long").alias("dims"),
                                                      r6(F.col("embedding")[0].cast("double")).alias("first_value"))


_REPORT = "'mail_' || id || '.eml' AS file, round(nb, 6) AS risk_score, CASE WHEN nb > 0.5 THEN 'score; lexicon' ELSE '' END AS risk_factors"


@query("s10_report_rows", build(f"""
SELECT 'csv' AS part, {_REPORT}, printf('%.3f', lr * 3) AS note FROM prob WHERE id % 17 <> 0
UNION ALL SELECT 'detail', {_REPORT}, CASE WHEN id % 17 = 0 THEN 'unreadable' ELSE '' END FROM prob
UNION ALL SELECT 'summary', k, CAST(v AS DOUBLE), '', '' FROM (SELECT unnest(['total_emails', 'phishing_emails', 'legitimate_emails', 'failed_emails']) AS k,
  unnest([count(*), count(*) FILTER (id % 17 <> 0 AND nb > 0.5), count(*) FILTER (id % 17 <> 0 AND nb <= 0.5), count(*) FILTER (id % 17 = 0)]) AS v FROM prob)""", "prob"))
def s10(spark, sf_dir):
    folder = scratch(spark, "report")
    df = view(spark, sf_dir, "prob").selectExpr(
        "concat('mail_', CAST(id AS STRING), '.eml') AS file", "nb AS risk_score", "lr * 3 AS analysis_time",
        "CASE WHEN id % 17 = 0 THEN 'unreadable' END AS error", "CASE WHEN nb > 0.5 THEN array('score', 'lexicon') ELSE array() END AS risk_factors")
    writers.write_reports(df, folder)
    empty = F.lit("")
    rows = spark.read.option("header", "true").option("escape", '"').csv(f"{folder}/csv").select(
        F.lit("csv").alias("part"), "file", r6(F.col("risk_score").cast("double")).alias("risk_score"), F.coalesce("risk_factors", empty).alias("risk_factors"), F.col("analysis_time").alias("note"))
    detail = spark.read.schema("file string, risk_score double, risk_factors array<string>, error string").json(f"{folder}/detail").select(
        F.lit("detail"), "file", r6("risk_score"), F.array_join(F.coalesce("risk_factors", F.array().cast("array<string>")), "; "), F.coalesce("error", empty))
    names = ("total_emails", "phishing_emails", "legitimate_emails", "failed_emails")
    summary = spark.read.schema(", ".join(f"{n} double" for n in names)).json(f"{folder}/summary").select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).alias("v")) for n in names])).alias("e")).select(F.lit("summary"), "e.k", "e.v", empty, empty)
    return rows.union(detail).union(summary)


@query("s11_detection_log", build("SELECT CAST(timestamp AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE is_phishing) AS phishing FROM detections GROUP BY 1", "detections"))
def s11(spark, sf_dir):
    folder = scratch(spark, "detections")
    log = view(spark, sf_dir, "detections")
    writers.append_detections(log.filter("is_phishing"), folder)
    writers.append_detections(log.filter("NOT is_phishing"), folder)
    return spark.read.parquet(folder).groupBy("day").agg(F.count("*").alias("n"), F.count_if("is_phishing").alias("phishing"))


@query("s12_corpus_sink", build(
    "SELECT source, split, count(*) AS n FROM (SELECT *, CASE WHEN rk <= t THEN 'test' WHEN rk <= t + ceil(round((total - t) * CAST(0.125 AS DOUBLE), 6)) THEN 'validation' ELSE 'train' END AS split "
    "FROM (SELECT *, ceil(round(total * CAST(0.2 AS DOUBLE), 6)) AS t FROM ranked)) GROUP BY ALL", "ranked"))
def s12(spark, sf_dir):
    folder = scratch(spark, "corpus")
    writers.write_corpus(corpus.split(view(spark, sf_dir, "corpus")), folder)
    return spark.read.parquet(folder).groupBy("source", "split").agg(F.count("*").alias("n"))
