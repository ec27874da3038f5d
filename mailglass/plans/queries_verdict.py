"""Ensemble and verdict queries (E rows); e7 is the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailglass import rules
from mailglass.operators import similarity
from mailglass.operators import verdict as ops
from mailglass.plans.bindings import AS_OF, view
from mailglass.plans.oracle_base import block, build, case, compact, d
from mailglass.plans.queries_content import BLEND
from mailglass.plans.queries_similarity import knn_votes, questions
from mailglass.plans.registry import joined, query, r6

W = rules.ENSEMBLE_WEIGHTS
_SPARSE = ("id AS mail_id, CASE WHEN id % 7 <> 0 THEN nb END AS sender, CASE WHEN id % 5 <> 0 THEN rf END AS image, CASE WHEN id % 3 <> 0 THEN lr END AS behavioral, "
           "CASE WHEN id % 35 <> 0 THEN 1 - nb END AS url, CASE WHEN id % 2 <> 0 THEN rf END AS llm, CASE WHEN id % 11 = 1 THEN lr END AS vector_similarity")


def mean(scores: dict[str, str], weights=W) -> str:
    top = " + ".join(f"coalesce({c} * {d(weights[n])}, 0)" for n, c in scores.items())
    low = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {d(weights[n])} END" for n, c in scores.items())
    return f"coalesce(({top}) / nullif({low}, 0), {d(0.5)})"


@query("e1_ensemble", build(f"SELECT mail_id, round({mean({n: n for n in W})}, 6) AS confidence FROM (SELECT {_SPARSE} FROM prob)", "prob"))
def e1(spark, sf_dir):
    view(spark, sf_dir, "prob").createOrReplaceTempView("prob_scores")
    df = spark.sql(f"SELECT {_SPARSE} FROM prob_scores")
    return df.select("mail_id", r6(ops.ensemble({n: F.col(n) for n in W}, W)).alias("confidence"))


@query("e1_ensemble_long", build(
    f"SELECT mail_id, round({mean({n: n for n in W})}, 6) AS confidence FROM (SELECT {_SPARSE} FROM prob) WHERE coalesce({', '.join(W)}) IS NOT NULL", "prob"))
def e1_long(spark, sf_dir):
    view(spark, sf_dir, "prob").createOrReplaceTempView("prob_scores")
    wide = spark.sql(f"SELECT {_SPARSE} FROM prob_scores")
    rows = wide.unpivot("mail_id", list(W), "component", "score")
    weights = spark.createDataFrame(list(W.items()), "component string, weight double")
    return ops.ensemble_long(rows, weights).withColumn("confidence", r6("confidence"))


@query("e2_borderline_stage", build(
    f"SELECT p.id AS mail_id, round(p.nb, 6) AS first_score, round(CASE WHEN round(abs(p.nb - 0.5), 9) < 0.3 THEN {BLEND.replace('knn', d(0.5))} END, 6) AS text_probability "
    "FROM prob p LEFT JOIN indic i ON i.mail_id = p.id", "prob", "indic"))
def e2(spark, sf_dir):
    first = view(spark, sf_dir, "prob").select(F.col("id").alias("mail_id"), F.col("nb").alias("first_score"))
    df = ops.second_stage(view(spark, sf_dir, "mail"), first)
    return df.select("mail_id", r6("first_score").alias("first_score"), r6("text_probability").alias("text_probability"))


@query("e3_band", build("SELECT id, CASE WHEN nb >= 0.8 THEN 'high' WHEN nb >= 0.5 THEN 'medium' ELSE 'low' END AS risk_level FROM prob", "prob"))
def e3(spark, sf_dir):
    return view(spark, sf_dir, "prob").select("id", ops.band(F.col("nb")).alias("risk_level"))


block("lite_base", f"""
SELECT m.mail_id, s.lite_sender_risk, s.factors AS sf, u.lite_url_risk, x.content_risk, x.factors AS cf,
  s.lite_sender_risk * {d(0.4)} + u.lite_url_risk * {d(0.4)} + x.content_risk * {d(0.2)} AS confidence
FROM mail m JOIN lite_sender s ON s.mail_id = m.mail_id JOIN lite_rollup u ON u.mail_id = m.mail_id JOIN lexicon x ON x.mail_id = m.mail_id""",
      "mail", "lite_sender", "lite_rollup", "lexicon")
_ADDR = "CASE mail_id % 12 WHEN 3 THEN 'no-at-sign' WHEN 7 THEN concat('two words@', domain) WHEN 11 THEN concat(sender, '.') ELSE sender END"


def lite_mail(spark, sf_dir):
    return view(spark, sf_dir, "mail").withColumn("sender", F.expr(_ADDR))


@query("e4_lite_ensemble", build(
    "SELECT mail_id, round(lite_sender_risk, 6) AS lite_sender_risk, round(lite_url_risk, 6) AS lite_url_risk, round(content_risk, 6) AS content_risk, round(confidence, 6) AS confidence, "
    "round(confidence, 9) >= 0.5 AS is_phishing, CASE WHEN round(confidence, 9) >= 0.8 THEN 'high' WHEN round(confidence, 9) >= 0.5 THEN 'medium' ELSE 'low' END AS risk_level FROM lite_base", "lite_base"))
def e4(spark, sf_dir):
    df = ops.lite_scores(lite_mail(spark, sf_dir), view(spark, sf_dir, "whois"), view(spark, sf_dir, "mx"), F.expr(AS_OF))
    return df.select("mail_id", *[r6(c).alias(c) for c in ("lite_sender_risk", "lite_url_risk", "content_risk", "confidence")], "is_phishing", "risk_level")


SORTED = "[x.t || ': ' || x.e || ' (' || CAST(CAST(round(x.r * 1000) AS BIGINT) AS VARCHAR) || ')' for x in list_sort([{'k': -round(y.r, 6), 'i': y.i, 't': y.t, 'e': y.e, 'r': y.r} for y in %s])]"


def number(items: str) -> str:
    return f"list_transform({items}, lambda x, i: {{'i': i, 't': x.t, 'e': x.e, 'r': x.r}})"


def shown(elements):
    return joined(F.transform(elements, lambda e: F.concat(e["type"], F.lit(": "), e["description"], F.lit(" ("),
                                                          F.round(e["risk_score"] * 1000).cast("long").cast("string"), F.lit(")"))))


@query("e5_elements", build(
    "SELECT b.mail_id, array_to_string(" + SORTED % number(
        "list_concat(list_concat([{'t': 'sender', 'e': f, 'r': b.lite_sender_risk} for f in b.sf], coalesce(l.items, [])), [{'t': 'content', 'e': f, 'r': b.content_risk} for f in b.cf])")
    + ", ' | ') AS elements FROM lite_base b LEFT JOIN (SELECT mail_id, list({'t': 'url', 'e': 'Suspicious URL: ' || link, 'r': link_risk} ORDER BY pos) AS items FROM lite_pos WHERE link_risk > 0 GROUP BY mail_id) l ON l.mail_id = b.mail_id",
    "lite_base", "lite_pos"))
def e5(spark, sf_dir):
    df = ops.lite_scores(lite_mail(spark, sf_dir), view(spark, sf_dir, "whois"), view(spark, sf_dir, "mx"), F.expr(AS_OF))
    return ops.lite_elements(df).select("mail_id", shown("suspicious_elements").alias("elements"))


# ---- flagship -----------------------------------------------------------------------
block("flag0", f"""
SELECT m.mail_id, s.sender_risk, s.is_new_domain, s.similar_to, s.spf_risk >= 0.7 OR s.dkim_risk = 0.8 AS auth_failed, a.misaligned, coalesce(g.image_risk, {d(0)}) AS image_risk,
  coalesce(g.factors, CAST([] AS VARCHAR[])) AS image_factors, b.behavior_risk, t.time_reason, o.geo_risk, o.origin_country, c.inconsistencies,
  u.url_risk, u.total_urls, u.suspicious_urls > 0 OR u.unique_domains > 2 OR u.shortener_count > 1 OR u.redirect_count > 2 AS url_suspicious,
  i.n, i.high, coalesce(v.phishing_probability, {d(0.5)}) AS knn, best.vector_similarity, best.similar_mails
FROM mail m JOIN sender_score s ON s.mail_id = m.mail_id JOIN align a ON a.mail_id = m.mail_id LEFT JOIN img_rollup g ON g.mail_id = m.mail_id
JOIN behavior b ON b.mail_id = m.mail_id JOIN time_risk t ON t.mail_id = m.mail_id JOIN geo o ON o.mail_id = m.mail_id JOIN consist c ON c.mail_id = m.mail_id
JOIN url_rollup u ON u.mail_id = m.mail_id JOIN indic i ON i.mail_id = m.mail_id LEFT JOIN votes v ON v.query_id = m.mail_id JOIN best ON best.mail_id = m.mail_id""",
      "mail", "sender_score", "align", "img_rollup", "behavior", "time_risk", "geo", "consist", "url_rollup", "indic", "votes", "best")
_FIRST = {"sender": "sender_risk", "image": "image_risk", "behavioral": "behavior_risk", "url": "url_risk"}
block("flag1", f"SELECT *, {mean(_FIRST)} AS first_score FROM flag0", "flag0")
block("flag2", f"SELECT *, CASE WHEN round(abs(first_score - 0.5), 9) < 0.3 THEN {BLEND} END AS text_probability FROM flag1", "flag1")
block("flag3", f"SELECT *, {mean({**_FIRST, 'llm': 'text_probability', 'vector_similarity': 'vector_similarity'})} AS confidence FROM flag2", "flag2")
block("flag", "SELECT *, round(confidence, 9) >= 0.5 AS is_phishing, CASE WHEN round(confidence, 9) >= 0.8 THEN 'high' WHEN round(confidence, 9) >= 0.5 THEN 'medium' ELSE 'low' END AS risk_level FROM flag3", "flag3")
_ADVICE = compact([
    case("is_phishing", "'Do not click on any links in this email'"), case("is_phishing", "'Do not download or open any attachments'"),
    case("is_phishing", "'Do not reply to this email'"),
    case("is_phishing AND is_new_domain", "'This email is from a newly registered domain, which is suspicious'"),
    case("is_phishing AND auth_failed", "'This email failed authentication checks (SPF/DKIM/DMARC)'"),
    case("is_phishing AND url_suspicious", "'Verify any mentioned organizations through official channels, not through links in this email'"),
    case("is_phishing AND similar_mails > 0", "'This email is similar to known phishing attempts in our database'"),
    case("risk_level = 'medium'", "'Exercise caution with this email'"),
    case("risk_level = 'medium'", "'Verify the sender through other channels before taking action'"),
    case("NOT is_phishing AND total_urls > 0", "'Hover over links to verify their destination before clicking'")])
_ELEMENTS = ("list_concat(list_concat(list_concat("
             "[{'t': 'sender', 'e': x, 'r': sender_risk} for x in list_concat(" + compact([
                 case("is_new_domain", "'Newly registered domain'"), case("similar_to IS NOT NULL", "'Domain resembles ' || similar_to")])
             + ", ['Header mismatch ' || h for h in misaligned])], coalesce(items, [])), "
             "[{'t': 'behavior', 'e': x, 'r': behavior_risk} for x in list_concat(" + compact(["time_reason", case("geo_risk > 0", "'High-risk origin ' || origin_country")])
             + ", inconsistencies)]), [{'t': 'image', 'e': x, 'r': image_risk} for x in image_factors])")


def snapshots(spark, sf_dir):
    known = view(spark, sf_dir, "vectors")
    names = ("whois", "dns_txt", "reputation", "dkim", "history", "ip_geo", "redirects", "images", "suffixes")
    return ops.Snapshots(
        **{n: view(spark, sf_dir, n) for n in names}, as_of=F.expr(AS_OF),
        neighbours=similarity.search_similar(known, questions(spark, sf_dir)), votes=knn_votes(known))


def verdicts(spark, sf_dir):
    return ops.score_mails(view(spark, sf_dir, "mail"), snapshots(spark, sf_dir))


@query("e7_mail_verdicts", build(
    "SELECT f.mail_id, is_phishing, round(confidence, 6) AS confidence, risk_level, round(first_score, 6) AS first_score, round(sender_risk, 6) AS sender_risk, round(image_risk, 6) AS image_risk, "
    "round(behavior_risk, 6) AS behavior_risk, round(url_risk, 6) AS url_risk, round(text_probability, 6) AS text_probability, round(vector_similarity, 6) AS vector_similarity, similar_mails, "
    "array_to_string(" + SORTED % number(_ELEMENTS) + f", ' | ') AS elements, array_to_string({_ADVICE}, ' | ') AS recommendations "
    "FROM flag f LEFT JOIN (SELECT mail_id, list({'t': 'url', 'e': 'Suspicious URL: ' || raw_url, 'r': risk} ORDER BY pos) AS items FROM verdicts WHERE suspicious GROUP BY mail_id) l ON l.mail_id = f.mail_id",
    "flag", "verdicts"))
def e7(spark, sf_dir):
    rounded = ("confidence", "first_score", "sender_risk", "image_risk", "behavior_risk", "url_risk", "text_probability", "vector_similarity")
    return verdicts(spark, sf_dir).select(
        "mail_id", "is_phishing", "risk_level", *[r6(c).alias(c) for c in rounded], "similar_mails",
        shown("suspicious_elements").alias("elements"), joined("recommendations").alias("recommendations"))


@query("e6_recommendations", build(f"SELECT mail_id, risk_level, array_to_string({_ADVICE}, ' | ') AS recommendations FROM flag", "flag"))
def e6(spark, sf_dir):
    return verdicts(spark, sf_dir).select("mail_id", "risk_level", joined("recommendations").alias("recommendations"))


_FAILED = "CASE WHEN id % 17 = 0 THEN 'unreadable' END"


@query("e8_batch_summary", build(
    "SELECT count(*) FILTER (WHERE e IS NULL) AS total, count(*) FILTER (WHERE e IS NULL AND c > 0.5) AS phishing, count(*) FILTER (WHERE e IS NULL AND NOT c > 0.5) AS legitimate, "
    f"count(*) FILTER (WHERE e IS NOT NULL) AS failed FROM (SELECT nb AS c, {_FAILED} AS e FROM prob)", "prob"))
def e8(spark, sf_dir):
    df = view(spark, sf_dir, "prob").selectExpr("nb AS confidence", f"{_FAILED} AS error")
    return ops.batch_summary(df, "error")


@query("e9_score_histogram", build(
    "SELECT CAST(least(floor(round(confidence, 9) * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM lite_base GROUP BY 1", "lite_base"))
def e9(spark, sf_dir):
    df = ops.lite_scores(lite_mail(spark, sf_dir), view(spark, sf_dir, "whois"), view(spark, sf_dir, "mx"), F.expr(AS_OF))
    return ops.score_histogram(df)
