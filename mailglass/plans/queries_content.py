"""Content queries (C rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailglass import rules
from mailglass.operators import content as ops
from mailglass.plans.bindings import view
from mailglass.plans.oracle_base import HOST_ONLY, block, build, case, compact, d, in_list, lit, str_list
from mailglass.plans.queries_senders import seen_domains
from mailglass.plans.registry import joined, query, r6


def _sum(conditions):
    return "(" + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in conditions) + ")"


block("lexicon", f"""
SELECT *, CASE WHEN biz THEN least({d(0.1)} * u, {d(0.3)}) + least({d(0.1)} * t, {d(0.3)}) ELSE least({d(0.15)} * u, {d(0.5)}) + least({d(0.15)} * t, {d(0.5)}) END AS content_risk,
  {compact([case('u > 0 AND biz', "'Contains urgent business-related terms'"), case('u > 0 AND NOT biz', "'Contains high-urgency language'"),
            case('t > 0 AND biz', "'Contains business-related warnings'"), case('t > 0 AND NOT biz', "'Contains threats or consequences'")])} AS factors
FROM (SELECT mail_id, ({' OR '.join(f"contains(low, '{t}')" for t in rules.BUSINESS_TERMS)}) AS biz,
  {_sum(f"contains(low, '{t}')" for t in rules.URGENT_TERMS)} AS u, {_sum(f"regexp_matches(low, {lit(p)})" for p in rules.THREAT_PATTERNS)} AS t
  FROM (SELECT mail_id, lower(raw) AS low FROM mail))""", "mail")


@query("c1_lexicon", build("SELECT mail_id, biz AS business_context, u AS urgent_terms, t AS threat_patterns, round(content_risk, 6) AS content_risk, array_to_string(factors, ' | ') AS content_factors FROM lexicon", "lexicon"))
def c1(spark, sf_dir):
    return ops.lexicon_score(view(spark, sf_dir, "mail")).select(
        "mail_id", "business_context", "urgent_terms", "threat_patterns", r6("content_risk").alias("content_risk"), joined("content_factors").alias("content_factors"))


IGNORE_CASE = "(?i)"
_families = ", ".join(
    f"{compact([case(f'regexp_matches(low, {lit(IGNORE_CASE + p)})', lit(f'{label}: ' + chr(39) + p + chr(39))) for p in patterns])} AS l_{family}"
    for family, (label, patterns) in rules.INDICATORS.items())
_severe = str_list([f"{label}: '{p}'" for label, patterns in rules.INDICATORS.values() for p in patterns if ops.is_high_risk(f"{label}: '{p}'")])


def _url_list(name, pattern):
    found = f"regexp_extract_all(raw, {lit('(?i)' + pattern)})"
    return f"[x for x in {found} if NOT starts_with(lower(x), 'http://www.')]" if name == "plain_host" else found


_urls = "flatten([" + ", ".join(_url_list(n, p) for n, p in rules.INDICATOR_URL_PATTERNS.items()) + "])"
block("indic", f"""
SELECT mail_id, len(l_phishing) AS n_phishing, len(l_urgency) AS n_urgency, len(l_request) AS n_request, len(urls) AS n_url, len(l_phrasing) AS n_phrasing, len(l_threat) AS n_threat,
  caps, bangs, len(inds) AS n, len([x for x in inds if list_contains({_severe}, x)]) + len(urls) AS high, inds
FROM (SELECT *, flatten([l_phishing, l_urgency, l_request, ['Suspicious URL: ''' || x || '''' for x in urls], l_phrasing, l_threat,
    {compact([case('caps > 3', "'Excessive capitalization: ' || CAST(caps AS VARCHAR) || ' instances'"), case('bangs > 3', "'Excessive exclamation marks: ' || CAST(bangs AS VARCHAR) || ' instances'")])}]) AS inds
  FROM (SELECT mail_id, {_families}, {_urls} AS urls,
    len([x for x in regexp_extract_all(raw, '[\\p{{L}}\\p{{N}}_]+') if regexp_matches(x, '^[A-Z]{{2,}}$')]) AS caps,
    length(raw) - length(replace(raw, '!', '')) AS bangs FROM (SELECT mail_id, raw, lower(raw) AS low FROM mail)))""", "mail")


@query("c2_indicators", build(
    "SELECT mail_id, " + ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in ("n_phishing", "n_urgency", "n_request", "n_url", "n_phrasing", "n_threat"))
    + ", CAST(caps AS INTEGER) AS capital_words, CAST(bangs AS INTEGER) AS exclamations, CAST(n AS INTEGER) AS n_indicators, CAST(high AS INTEGER) AS high_risk, array_to_string(inds, ' | ') AS indicators FROM indic", "indic"))
def c2(spark, sf_dir):
    return ops.indicators(view(spark, sf_dir, "mail")).select(
        "mail_id", "n_phishing", "n_urgency", "n_request", "n_url", "n_phrasing", "n_threat", "capital_words", "exclamations",
        "n_indicators", "high_risk", joined("indicators").alias("indicators"))


BLEND = ("CASE WHEN n > 0 THEN knn * (1 - least({8}, n * {1})) + least({95}, least({9}, n * {08}) + high * {05}) * least({8}, n * {1}) ELSE knn END"
         .replace("{8}", d(0.8)).replace("{1}", d(0.1)).replace("{95}", d(0.95)).replace("{9}", d(0.9)).replace("{08}", d(0.08)).replace("{05}", d(0.05)))


@query("c3_indicator_blend", build(
    f"SELECT mail_id, round({BLEND}, 6) AS phishing_probability FROM (SELECT i.*, p.nb AS knn FROM indic i JOIN prob p ON p.id = i.mail_id)", "indic", "prob"))
def c3(spark, sf_dir):
    df = ops.indicators(view(spark, sf_dir, "mail")).select("mail_id", "n_indicators", "high_risk")
    df = df.join(view(spark, sf_dir, "prob").select(F.col("id").alias("mail_id"), F.col("nb").alias("knn")), "mail_id")
    return df.select("mail_id", r6(ops.blended_probability(F.col("knn"), F.col("n_indicators"), F.col("high_risk"))).alias("phishing_probability"))


_FTEXT = "concat('Subject: ', subject, chr(10), chr(10), raw, CASE WHEN mail_id % 6 = 1 THEN '[here](http://x.example.com/a)' ELSE '' END)"


@query("c4_hand_features", build(rf"""
SELECT mail_id, CAST(len(regexp_extract_all(t, {HOST_ONLY})) AS INTEGER) AS url_count,
  CAST(len([x for x in regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+') if x IN {in_list(rules.SUSPICIOUS_TOKENS)}]) AS INTEGER) AS suspicious_words,
  CAST(regexp_matches(t, '(?i)^(?:Subject: Re:|Subject: Fwd:)') AS INTEGER) AS reply_or_forward, CAST(length(t) AS INTEGER) AS text_length,
  CAST(length(t) - length(replace(t, '!', '')) AS INTEGER) AS exclamation_count, CAST(length(t) - length(replace(t, '$', '')) AS INTEGER) AS dollar_count,
  CAST(regexp_matches(t, 'https?://\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}') AS INTEGER) AS ip_in_url,
  CAST(regexp_matches(t, '\[.*\]\(https?://.*\)') AS INTEGER) AS markdown_link
FROM (SELECT mail_id, {_FTEXT} AS t FROM mail)""", "mail"))
def c4(spark, sf_dir):
    df = view(spark, sf_dir, "mail").selectExpr("mail_id", f"{_FTEXT} AS text")
    return ops.hand_features(df).select("mail_id", *ops.FEATURES)


@query("c5_keyword_elements", build(
    "SELECT mail_id, 'keyword' AS type, 'Suspicious keyword: ' || k AS description, round(0.6 + nb * 0.2, 6) AS risk_score FROM ("
    f"SELECT m.mail_id, p.nb, unnest([k for k in {str_list(rules.ELEMENT_KEYWORDS)} if contains(lower(m.raw), k)]) AS k FROM mail m JOIN prob p ON p.id = m.mail_id)", "mail", "prob"))
def c5(spark, sf_dir):
    df = view(spark, sf_dir, "mail").join(view(spark, sf_dir, "prob").select(F.col("id").alias("mail_id"), "nb"), "mail_id")
    return ops.keyword_elements(df, "raw", "nb").withColumn("risk_score", r6("risk_score"))


_brand_hits = compact(case(f"len([h for h in hosts if contains(h, '{tok}') AND h <> '{own}' AND NOT ends_with(h, '.{own}')]) > 0", lit(f"{label} impersonation"))
                      for label, tok, own in rules.IMPERSONATION_BRANDS)
block("img_hosts", f"SELECT *, [lower(regexp_replace(u, '^https?://', '')) for u in regexp_extract_all(ocr_text, {HOST_ONLY})] AS hosts FROM images", "images")
block("manip", rf"""
SELECT * EXCLUDE (odd, brands, cheap), len(odd) + len(brands) AS high_findings, CAST(cheap AS INTEGER) AS medium_findings, len(odd) + len(brands) > 0 OR cheap AS has_manipulated_urls,
  list_concat(list_concat(odd, brands), CASE WHEN cheap THEN ['Suspicious TLD detected'] ELSE CAST([] AS VARCHAR[]) END) AS manipulated,
  least({d(0.9)}, (len(odd) + len(brands)) * {d(0.3)} + CAST(cheap AS INTEGER) * {d(0.15)}) AS manipulation_risk
FROM (SELECT *, [u for u in regexp_extract_all(ocr_text, 'https?://[^\s<>\x22]+') if regexp_matches(u, '[^\x00-\x7F]')] AS odd,
  {_brand_hits} AS brands, len([h for h in hosts if string_split(h, '.')[-1] IN {in_list(rules.SUSPICIOUS_TLDS)}]) > 0 AS cheap FROM (SELECT * REPLACE (list_concat(hosts, mentioned) AS hosts) FROM mentions))""", "mentions")


@query("c6_url_manipulation", build(
    "SELECT image_id, has_manipulated_urls, CAST(high_findings AS INTEGER) AS high_findings, medium_findings, array_to_string(manipulated, ' | ') AS manipulated, round(manipulation_risk, 6) AS manipulation_risk FROM manip", "manip"))
def c6(spark, sf_dir):
    return ops.url_manipulation(view(spark, sf_dir, "images")).select(
        "image_id", "has_manipulated_urls", "high_findings", "medium_findings", joined("manipulated").alias("manipulated"), r6("manipulation_risk").alias("manipulation_risk"))


block("mentions", r"""
SELECT *, list_filter(ms, lambda x, i: list_position(ms, x) = i AND len([h for h in hosts if contains(h, x)]) = 0) AS mentioned
FROM (SELECT *, [lower(m) for m in regexp_extract_all(regexp_replace(ocr_text, '\s', '  ', 'g'), '(?:^|[^\p{L}\p{N}_])((?:www\.)?(?:[a-zA-Z0-9][-a-zA-Z0-9]*\.)+[a-zA-Z]{2,})(?:$|[^\p{L}\p{N}_])', 1)] AS ms FROM img_hosts)""", "img_hosts")


def typos(names: list[str]) -> str:
    """Candidate rows (name, candidate) from generated positions and letters."""
    like = "MAP {" + ", ".join(f"'{k}': {str_list(v)}" for k, v in rules.LOOKALIKES.items()) + "}"
    return f"""
SELECT name, substr(name, 1, p - 1) || c || substr(name, p + 1) AS candidate FROM
  (SELECT unnest({str_list(names)}) AS name), (SELECT unnest(range(1, 60)) AS p), (SELECT unnest(string_split('{rules.TYPO_ALPHABET}', '')) AS c) WHERE p <= length(name) AND substr(name, p, 1) <> c
UNION SELECT name, substr(name, 1, p - 1) || c || substr(name, p) FROM
  (SELECT unnest({str_list(names)}) AS name), (SELECT unnest(range(1, 60)) AS p), (SELECT unnest(string_split('{rules.TYPO_ALPHABET}', '')) AS c) WHERE p <= length(name) + 1
UNION SELECT name, substr(name, 1, p - 1) || substr(name, p + 1) FROM (SELECT unnest({str_list(names)}) AS name), (SELECT unnest(range(1, 60)) AS p) WHERE p <= length(name)
UNION SELECT name, substr(name, 1, p - 1) || substr(name, p + 1, 1) || substr(name, p, 1) || substr(name, p + 2) FROM (SELECT unnest({str_list(names)}) AS name), (SELECT unnest(range(1, 60)) AS p) WHERE p < length(name)
UNION SELECT name, substr(name, 1, p - 1) || c || substr(name, p + 1) FROM (SELECT name, p, unnest({like}[substr(name, p, 1)]) AS c FROM
  (SELECT unnest({str_list(names)}) AS name), (SELECT unnest(range(1, 60)) AS p) WHERE p <= length(name))"""


block("brand_typos", typos([b.replace(" ", "") for b in rules.IMAGE_BRANDS]))
block("trusted_typos", typos(rules.SENDER_TRUSTED))
_named = "coalesce(logo_brand, " + ", ".join(f"CASE WHEN contains(lower(ocr_text), '{b}') THEN '{b}' END" for b in rules.IMAGE_BRANDS) + ")"
block("imperson", f"""
SELECT x.image_id, x.brand, x.nhosts, coalesce(t.bad, CAST([] AS VARCHAR[])) AS mismatched, x.brand IS NOT NULL AND t.bad IS NOT NULL AS is_impersonation,
  CASE WHEN x.brand IS NULL THEN {d(0)} WHEN t.bad IS NOT NULL THEN {d(0.9)} WHEN x.nhosts > 0 THEN {d(0.5)} ELSE {d(0.2)} END AS impersonation_risk
FROM (SELECT image_id, {_named} AS brand, len(hosts) + len(mentioned) AS nhosts FROM mentions) x
LEFT JOIN (SELECT image_id, list(host ORDER BY pos) AS bad FROM (
    SELECT DISTINCT m.image_id, m.host, m.pos FROM (
      SELECT image_id, brand, host, pos, unnest(string_split(host, '.')) AS label FROM (
        SELECT image_id, {_named} AS brand, unnest(list_concat(hosts, mentioned)) AS host, generate_subscripts(list_concat(hosts, mentioned), 1) AS pos FROM mentions)) m
    JOIN brand_typos b ON b.name = regexp_replace(m.brand, '[_ ]', '', 'g') AND b.candidate = m.label) GROUP BY image_id) t ON t.image_id = x.image_id""", "mentions", "brand_typos")


@query("c7_brand_impersonation", build(
    "SELECT image_id, brand, array_to_string(mismatched, ' | ') AS mismatched_hosts, is_impersonation, impersonation_risk FROM imperson", "imperson"))
def c7(spark, sf_dir):
    return ops.brand_impersonation(view(spark, sf_dir, "images")).select(
        "image_id", "brand", joined("mismatched_hosts").alias("mismatched_hosts"), "is_impersonation", "impersonation_risk")


@query("c8_domain_mentions", build(
    "SELECT image_id, array_to_string(hosts, ' | ') AS link_hosts, array_to_string(mentioned, ' | ') AS mentioned_domains FROM mentions", "mentions"))
def c8(spark, sf_dir):
    return ops.domain_mentions(view(spark, sf_dir, "images")).select(
        "image_id", joined("link_hosts").alias("link_hosts"), joined("mentioned_domains").alias("mentioned_domains"))


@query("c9_typo_candidates", build(
    "SELECT s.domain, t.name AS similar_to FROM seen s JOIN trusted_typos t ON t.candidate = s.domain WHERE t.name <> s.domain", "seen", "trusted_typos"))
def c9(spark, sf_dir):
    return ops.match_typos(seen_domains(spark, sf_dir), rules.SENDER_TRUSTED)


block("html_imgs", r"""
SELECT page_id, 'inline' AS source, z.k AS type, md5(from_base64(z.v)) AS hash, CAST(NULL AS VARCHAR) AS url FROM (
  SELECT page_id, unnest(list_zip(regexp_extract_all(html, 'src="data:image/([^;]+);base64,([^"]+)"', 1), regexp_extract_all(html, 'src="data:image/([^;]+);base64,([^"]+)"', 2))) AS zz,
    {'k': zz[1], 'v': zz[2]} AS z FROM html)
UNION ALL SELECT page_id, 'remote', regexp_extract(u, '[^/]\.([^./]+)$', 1), NULL, u FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '<img[^>]+src="(https?://[^"]+)"', 1)) AS u FROM html)""", "html")


@query("c10_extract_images", build("SELECT page_id, source, type, hash, url FROM html_imgs", "html_imgs"))
def c10(spark, sf_dir):
    return ops.extract_images(view(spark, sf_dir, "html"), "page_id", "html").drop("pos")


@query("c10_distinct_images", build(
    "SELECT hash, count(*) AS uses, min(page_id) AS first_seen, min(type) AS type FROM html_imgs WHERE hash IS NOT NULL GROUP BY hash", "html_imgs"))
def c10_distinct(spark, sf_dir):
    return ops.distinct_images(ops.extract_images(view(spark, sf_dir, "html"), "page_id", "html"), "page_id")


block("img_scored", f"""
SELECT m.mail_id, m.image_id, i.is_impersonation AS f1, m.has_manipulated_urls AS f2, i.nhosts > 0 AS f3,
  CASE WHEN i.is_impersonation OR m.has_manipulated_urls OR i.nhosts > 0 THEN greatest({d(0)}, CASE WHEN i.is_impersonation THEN i.impersonation_risk ELSE {d(0)} END,
    CASE WHEN m.has_manipulated_urls THEN m.manipulation_risk ELSE {d(0)} END, CASE WHEN i.nhosts > 0 THEN {d(0.5)} ELSE {d(0)} END)
    WHEN trim(m.ocr_text) <> '' AND m.logo_brand IS NOT NULL THEN {d(0.3)} ELSE {d(0)} END AS image_risk
FROM manip m JOIN imperson i ON i.image_id = m.image_id WHERE m.width >= 20 AND m.height >= 20""", "manip", "imperson")
block("img_rollup", f"""
SELECT a.mail_id, a.image_count, coalesce(b.analyzed_images, 0) AS analyzed_images, coalesce(b.image_risk, {d(0)}) AS image_risk,
  {compact([case('f1', "'Brand impersonation detected'"), case('f2', "'URL manipulation detected'"), case('f3', "'URLs embedded in image'")])} AS factors
FROM (SELECT mail_id, count(*) AS image_count FROM images GROUP BY mail_id) a LEFT JOIN
  (SELECT mail_id, count(*) AS analyzed_images, max(image_risk) AS image_risk, bool_or(f1) AS f1, bool_or(f2) AS f2, bool_or(f3) AS f3 FROM img_scored GROUP BY mail_id) b ON b.mail_id = a.mail_id""",
      "images", "img_scored")


@query("c11_image_rollup", build(
    "SELECT mail_id, image_count, analyzed_images, round(image_risk, 6) AS image_risk, array_to_string(factors, ' | ') AS image_factors FROM img_rollup", "img_rollup"))
def c11(spark, sf_dir):
    return ops.roll_up_images(view(spark, sf_dir, "images")).select(
        "mail_id", "image_count", "analyzed_images", r6("image_risk").alias("image_risk"), joined("image_factors").alias("image_factors"))
