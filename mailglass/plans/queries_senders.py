"""Sender (N rows) and behaviour (B rows) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailglass import rules
from mailglass.operators import behavior, senders
from mailglass.operators.mail import header_metadata
from mailglass.plans.bindings import AS_OF, view
from mailglass.plans.oracle_base import block, build, case, compact, d, decoded, header, in_list, lit, str_list
from mailglass.plans.registry import joined, query, r6

# addresses as found in the wild: a few of them malformed
_ADDRESS = ("CASE mail_id % 12 WHEN 3 THEN 'no-at-sign' WHEN 7 THEN concat('two words@', domain) WHEN 11 THEN concat(sender, '.') ELSE sender END")
A = r"'^([a-zA-Z0-9._%+-]+)@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})$'"


def _as_of():
    return F.expr(AS_OF)


def domains(spark, sf_dir):
    return view(spark, sf_dir, "mail").select("domain").distinct()


@query("n1_parse_address", build(
    f"SELECT mail_id, address, nullif(regexp_extract(address, {A}, 1), '') AS username, nullif(regexp_extract(address, {A}, 2), '') AS domain "
    f"FROM (SELECT mail_id, {_ADDRESS} AS address FROM mail)", "mail"))
def n1(spark, sf_dir):
    return senders.parse_address(view(spark, sf_dir, "mail").selectExpr("mail_id", f"{_ADDRESS} AS address"), "address")


block("doms", "SELECT DISTINCT domain FROM mail", "mail")
block("age", f"""
SELECT *, CASE WHEN NOT found THEN {d(0.5)} WHEN days IS NULL THEN {d(0)} WHEN days < 30 THEN {d(0.9)} WHEN days < 90 THEN {d(0.6)}
    WHEN days < 180 THEN {d(0.3)} ELSE {d(0.1)} END AS age_risk,
  CASE WHEN NOT found THEN {d(0.1)} WHEN days < 14 THEN {d(0.3)} WHEN days < 30 THEN {d(0.15)} ELSE {d(0)} END AS lite_age_risk
FROM (SELECT x.domain, w.registrar, coalesce(w.ok, false) AS found, strftime(w.creation_dates[1], '%Y-%m-%d') AS registration_date,
    CASE WHEN w.ok THEN CAST(floor((epoch({AS_OF}) - epoch(w.creation_dates[1])) / 86400) AS BIGINT) END AS days
  FROM doms x LEFT JOIN whois w ON w.domain = x.domain)""", "doms", "whois")


@query("n2_domain_age", build(
    "SELECT domain, registrar, days AS domain_age_days, coalesce(days < 30, false) AS is_new_domain, "
    "CASE WHEN days IS NOT NULL THEN registration_date END AS registration_date, age_risk FROM age", "age"))
def n2(spark, sf_dir):
    df = senders.domain_age(domains(spark, sf_dir), view(spark, sf_dir, "whois"), _as_of())
    return df.select("domain", "registrar", "domain_age_days", "is_new_domain", "registration_date", "age_risk")


@query("n3_lite_age", build("SELECT domain, lite_age_risk FROM age", "age"))
def n3(spark, sf_dir):
    return senders.domain_age(domains(spark, sf_dir), view(spark, sf_dir, "whois"), _as_of()).select("domain", "lite_age_risk")


_NAME = "lower(split_part(regexp_replace(m, '^[+~?-]', ''), ':', 1))"
_VALUE = "split_part(regexp_replace(regexp_replace(m, '^[+~?-]', ''), '^[^:]*:?', ''), '/', 1)"
block("spf0", """
SELECT x.domain, r.txt AS spf_record, list_filter(string_split(replace(r.txt, '"', ''), ' '), lambda t: t <> '')[2:] AS mechs,
  coalesce(s.nx, false) AS nx, coalesce(s.err, false) AS err
FROM doms x LEFT JOIN (SELECT name, txt, row_number() OVER (PARTITION BY name ORDER BY ord) AS rn FROM dns_txt WHERE contains(txt, 'v=spf1')) r
  ON r.name = x.domain AND r.rn = 1
LEFT JOIN (SELECT name, bool_or(status = 'NXDOMAIN') AS nx, bool_or(status = 'ERROR') AS err FROM dns_txt GROUP BY name) s ON s.name = x.domain""",
      "doms", "dns_txt")
block("spf1", f"""
SELECT *, spf_record IS NOT NULL AS has_spf, [m for m in mechs if m IN ('+all', '-all', '~all', '?all')][1] AS spf_all,
  coalesce(len([m for m in mechs if {_NAME} NOT IN {in_list(rules.SPF_MECHANISMS)}
      OR ({_NAME} = 'ip4' AND contains(m, ':') AND NOT regexp_matches({_VALUE}, {lit(senders.IPV4)}))
      OR ({_NAME} = 'ip6' AND contains(m, ':') AND NOT (regexp_matches({_VALUE}, {lit(senders.IPV6)}) AND length({_VALUE}) - length(replace({_VALUE}, ':', '')) <= 7))]) = 0
    AND len([m for m in mechs if {_NAME} = 'all']) = 1, false) AS spf_valid
FROM spf0""", "spf0")
block("spf", f"""
SELECT *, CASE WHEN has_spf THEN CASE WHEN spf_valid THEN ball ELSE greatest(ball, {d(0.7)}) END WHEN nx THEN {d(1)} WHEN err THEN {d(0.6)} ELSE {d(0.8)} END AS spf_risk
FROM (SELECT *, CASE spf_all WHEN '-all' THEN {d(0.2)} WHEN '~all' THEN {d(0.4)} WHEN '?all' THEN {d(0.6)} WHEN '+all' THEN {d(0.8)} ELSE {d(0.5)} END AS ball FROM spf1)""", "spf1")


@query("n4_spf", build("SELECT domain, has_spf, spf_record, spf_all, spf_valid, "
                       "array_to_string([m[9:] for m in mechs if starts_with(m, 'include:')], ' ') AS spf_includes, spf_risk FROM spf", "spf"))
def n4(spark, sf_dir):
    df = senders.spf(domains(spark, sf_dir), view(spark, sf_dir, "dns_txt"))
    return df.select("domain", "has_spf", "spf_record", "spf_all", "spf_valid", joined("spf_includes", " ").alias("spf_includes"), "spf_risk")


@query("n5_spf_validity", build("SELECT domain, array_to_string(mechs, ' ') AS mechanisms, spf_valid FROM spf WHERE has_spf", "spf"))
def n5(spark, sf_dir):
    df = senders.spf(domains(spark, sf_dir), view(spark, sf_dir, "dns_txt")).filter("has_spf")
    return df.select("domain", joined("spf_mechanisms", " ").alias("mechanisms"), "spf_valid")


block("dkim_j", f"""
SELECT mail_id, sig IS NOT NULL AS has_dkim, sig IS NOT NULL AND coalesce(verified, false) AND NOT coalesce(error, false) AS dkim_valid,
  nullif(regexp_extract(sig, 'd=([^;]+)', 1), '') AS dkim_domain, nullif(regexp_extract(sig, 's=([^;]+)', 1), '') AS dkim_selector,
  CASE WHEN sig IS NULL THEN {d(0.5)} WHEN coalesce(error, verified IS NULL) THEN {d(0.6)} WHEN verified THEN {d(0.1)} ELSE {d(0.8)} END AS dkim_risk
FROM (SELECT h.mail_id, {header('DKIM-Signature')} AS sig, k.verified, k.error FROM hdr h LEFT JOIN dkim k ON k.mail_id = h.mail_id)""", "hdr", "dkim")


@query("n6_dkim", build("SELECT * FROM dkim_j", "dkim_j"))
def n6(spark, sf_dir):
    df = senders.dkim(view(spark, sf_dir, "mail"), view(spark, sf_dir, "dkim"))
    return df.select("mail_id", "has_dkim", "dkim_valid", "dkim_domain", "dkim_selector", "dkim_risk")


block("dmarc", f"""
SELECT domain, rec IS NOT NULL AS has_dmarc, pol AS dmarc_policy, nullif(regexp_extract(rec, 'sp=(\\w+)', 1), '') AS dmarc_subdomain_policy,
  TRY_CAST(nullif(regexp_extract(rec, 'pct=(\\d+)', 1), '') AS INTEGER) AS dmarc_pct,
  nullif(regexp_extract(rec, 'rua=mailto:([^;]+)', 1), '') AS dmarc_rua, nullif(regexp_extract(rec, 'ruf=mailto:([^;]+)', 1), '') AS dmarc_ruf,
  CASE WHEN rec IS NOT NULL THEN CASE pol WHEN 'reject' THEN {d(0.1)} WHEN 'quarantine' THEN {d(0.2)} ELSE {d(0.3)} END
       WHEN coalesce(answered, false) THEN {d(0.7)} ELSE {d(0.5)} END AS dmarc_risk
FROM (SELECT *, nullif(regexp_extract(rec, 'p=(\\w+)', 1), '') AS pol FROM (
  SELECT x.domain, replace(r.txt, '"', '') AS rec, s.answered FROM doms x
  LEFT JOIN (SELECT name, txt, row_number() OVER (PARTITION BY name ORDER BY ord) AS rn FROM dns_txt WHERE contains(txt, 'v=DMARC1')) r
    ON r.name = '_dmarc.' || x.domain AND r.rn = 1
  LEFT JOIN (SELECT name, bool_or(status = 'NOERROR') AS answered FROM dns_txt GROUP BY name) s ON s.name = '_dmarc.' || x.domain))""", "doms", "dns_txt")


@query("n7_dmarc", build("SELECT * FROM dmarc", "dmarc"))
def n7(spark, sf_dir):
    return senders.dmarc(domains(spark, sf_dir), view(spark, sf_dir, "dns_txt")).drop("dmarc_record")


block("rep", f"""
SELECT x.domain, CASE WHEN x.domain IN {in_list(rules.SENDER_TRUSTED)} THEN {d(0.9)} ELSE coalesce(r.reputation_score, {d(0.5)}) END AS reputation_score,
  CASE WHEN x.domain IN {in_list(rules.SENDER_TRUSTED)} THEN false ELSE coalesce(r.blacklisted, false) END AS blacklisted,
  CASE WHEN x.domain IN {in_list(rules.SENDER_TRUSTED)} THEN 0 ELSE coalesce(r.blacklist_count, 0) END AS blacklist_count,
  CASE WHEN x.domain IN {in_list(rules.SENDER_TRUSTED)} THEN '' ELSE coalesce(replace(r.sources, ',', ' | '), '') END AS sources,
  CASE WHEN x.domain IN {in_list(rules.SENDER_TRUSTED)} THEN {d(0.1)} ELSE coalesce(1 - r.reputation_score, {d(0.5)}) END AS reputation_risk
FROM doms x LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ord) AS rn FROM reputation) r ON r.domain = x.domain AND r.rn = 1""",
      "doms", "reputation")


@query("n8_reputation", build("SELECT domain, reputation_score, blacklisted, blacklist_count, sources, round(reputation_risk, 6) AS reputation_risk FROM rep", "rep"))
def n8(spark, sf_dir):
    df = senders.reputation(domains(spark, sf_dir), view(spark, sf_dir, "reputation"))
    return df.select("domain", "reputation_score", "blacklisted", "blacklist_count", joined("sources").alias("sources"), r6("reputation_risk").alias("reputation_risk"))


# registered names and hosts seen anywhere in mails and pages
block("seen", r"""
SELECT domain FROM doms UNION SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) FROM urls""", "doms", "urls")


def seen_domains(spark, sf_dir):
    hosts = view(spark, sf_dir, "urls").select(F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#:]*)", 1)).alias("domain"))
    return domains(spark, sf_dir).union(hosts).distinct()


block("typo_pairs", "SELECT s.domain, t.name, t.ord, levenshtein(s.domain, t.name) AS distance, greatest(length(s.domain), length(t.name)) AS longest "
      f"FROM seen s, (SELECT unnest({str_list(rules.SENDER_TRUSTED)}) AS name, generate_subscripts({str_list(rules.SENDER_TRUSTED)}, 1) AS ord) t "
      f"WHERE s.domain NOT IN {in_list(rules.SENDER_TRUSTED)}", "seen")
block("typo", f"""
SELECT s.domain, coalesce(n.distance <= 2, false) AS typo_suspicious, CASE WHEN n.distance <= 2 THEN n.name END AS similar_to,
  CAST(n.distance AS INTEGER) AS edit_distance, coalesce({d(1)} - n.distance / CAST(n.longest AS DOUBLE), {d(0)}) AS similarity,
  CASE WHEN n.distance = 1 THEN {d(0.9)} WHEN n.distance <= 2 THEN {d(0.7)} ELSE {d(0)} END AS typo_risk
FROM seen s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY distance, ord) AS rn FROM typo_pairs) n ON n.domain = s.domain AND n.rn = 1""",
      "seen", "typo_pairs")


@query("n9_look_alike", build("SELECT domain, typo_suspicious, similar_to, edit_distance, round(similarity, 6) AS similarity, typo_risk FROM typo", "typo"))
def n9(spark, sf_dir):
    df = senders.look_alike(seen_domains(spark, sf_dir))
    return df.select("domain", "typo_suspicious", "similar_to", "edit_distance", r6("similarity").alias("similarity"), "typo_risk")


# trusted domains of all suppliers and customers; a name in four of each five is changed by one to three edits
block("partners", "SELECT lower(replace(s_name, '#', '')) || '.com' AS name, s_suppkey AS ord FROM supplier UNION ALL SELECT lower(replace(c_name, '#', '')) || '.com', 100000000 + c_custkey FROM customer")
block("imitated", """
SELECT DISTINCT CASE ord % 5 WHEN 0 THEN name WHEN 1 THEN left(name, k - 1) || substr(name, k + 1) WHEN 2 THEN left(name, k) || '-' || substr(name, k + 1)
  WHEN 3 THEN left(name, k - 1) || 'x' || substr(name, k + 1, 2) || 'y' || substr(name, k + 4) ELSE left(name, k - 1) || 'xyz' || substr(name, k) END AS domain
FROM (SELECT *, CAST(1 + ord % 7 AS INTEGER) AS k FROM partners)""", "partners")


def partners(spark, sf_dir):
    def named(table, name, key, add):
        return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(
            F.concat(F.lower(F.replace(F.col(name), F.lit("#"), F.lit(""))), F.lit(".com")).alias("domain"), (F.col(key) + add).alias("ord"))

    return named("supplier", "s_name", "s_suppkey", 0).unionByName(named("customer", "c_name", "c_custkey", 100000000))


def imitated(trusted):
    name, k, kind = F.col("domain"), (F.col("ord") % 7 + 1).cast("int"), F.col("ord") % 5
    rest = lambda at: F.substring(name, at, F.length(name))
    changed = (F.when(kind == 0, name).when(kind == 1, F.concat(F.left(name, k - 1), rest(k + 1))).when(kind == 2, F.concat(F.left(name, k), F.lit("-"), rest(k + 1)))
               .when(kind == 3, F.concat(F.left(name, k - 1), F.lit("x"), F.substring(name, k + 1, F.lit(2)), F.lit("y"), rest(k + 4)))
               .otherwise(F.concat(F.left(name, k - 1), F.lit("xyz"), rest(k))))
    return trusted.select(changed.alias("domain")).distinct()


@query("n9_look_alike_table", build(f"""
SELECT i.domain, n.domain IS NOT NULL AS typo_suspicious, n.name AS similar_to, CAST(n.distance AS INTEGER) AS edit_distance,
  round(coalesce({d(1)} - n.distance / CAST(greatest(length(n.domain), length(n.name)) AS DOUBLE), {d(0)}), 6) AS similarity, CASE n.distance WHEN 1 THEN {d(0.9)} WHEN 2 THEN {d(0.7)} ELSE {d(0)} END AS typo_risk
FROM imitated i LEFT JOIN (
  SELECT * FROM (SELECT x.domain, p.name, levenshtein(x.domain, p.name) AS distance, row_number() OVER (PARTITION BY x.domain ORDER BY distance, p.ord) AS rn
    FROM imitated x JOIN partners p ON abs(length(x.domain) - length(p.name)) <= 2 WHERE levenshtein(x.domain, p.name) <= 2) WHERE rn = 1 AND distance > 0) n ON n.domain = i.domain""", "partners", "imitated"))
def n9_table(spark, sf_dir):
    trusted = partners(spark, sf_dir)
    df = senders.look_alike(imitated(trusted), trusted)
    return df.select("domain", "typo_suspicious", "similar_to", "edit_distance", r6("similarity").alias("similarity"), "typo_risk")


block("align", f"""
SELECT mail_id, {compact([case('own IS NOT NULL AND fd <> own', "'From: ' || fd"), case('own IS NOT NULL AND rd <> own', "'Return-Path: ' || rd"),
                          case('own IS NOT NULL AND pd <> own', "'Reply-To: ' || pd")])} AS misaligned
FROM (SELECT mail_id, nullif(regexp_extract(sender, {A}, 2), '') AS own,
    nullif(regexp_extract({decoded(header('From'))}, '@([^>\\s]+)', 1), '') AS fd,
    nullif(regexp_extract(regexp_extract({header('Return-Path')}, '<([^>]+)>', 1), {A}, 2), '') AS rd,
    nullif(regexp_extract(regexp_extract({decoded(header('Reply-To'))}, '([^<\\s]+@[^>\\s]+)', 1), {A}, 2), '') AS pd FROM hdr)""", "hdr")


@query("n10_alignment", build(
    f"SELECT mail_id, array_to_string(misaligned, ' | ') AS misaligned_headers, CASE WHEN len(misaligned) > 0 THEN {d(0.8)} ELSE {d(0)} END AS alignment_risk FROM align", "align"))
def n10(spark, sf_dir):
    df = senders.alignment(view(spark, sf_dir, "mail"))
    return df.select("mail_id", joined("misaligned_headers").alias("misaligned_headers"), "alignment_risk")


W = rules.SENDER_WEIGHTS
block("sender_score", f"""
SELECT m.mail_id, m.sender, age.age_risk, rep.reputation_risk, typo.typo_risk, spf.spf_risk, dmarc.dmarc_risk, k.dkim_risk,
  coalesce(age.days < 30, false) AS is_new_domain, typo.similar_to,
  CASE WHEN len(al.misaligned) > 0 THEN {d(0.8)} ELSE {d(0)} END AS alignment_risk,
  (age.age_risk * {d(W['domain_age'])} + rep.reputation_risk * {d(W['domain_reputation'])} + typo.typo_risk * {d(W['typosquatting'])}
   + spf.spf_risk * {d(W['spf'])} + dmarc.dmarc_risk * {d(W['dmarc'])} + k.dkim_risk * {d(W['dkim'])}
   + CASE WHEN len(al.misaligned) > 0 THEN {d(0.8)} ELSE {d(0)} END * {d(W['domain_alignment'])}) AS sender_risk
FROM mail m JOIN age ON age.domain = m.domain JOIN rep ON rep.domain = m.domain JOIN typo ON typo.domain = m.domain
JOIN spf ON spf.domain = m.domain JOIN dmarc ON dmarc.domain = m.domain JOIN dkim_j k ON k.mail_id = m.mail_id JOIN align al ON al.mail_id = m.mail_id""",
      "mail", "age", "rep", "typo", "spf", "dmarc", "dkim_j", "align")


def scored_senders(spark, sf_dir, mail=None):
    mail = view(spark, sf_dir, "mail") if mail is None else mail
    return senders.score_senders(mail, view(spark, sf_dir, "whois"), view(spark, sf_dir, "dns_txt"),
                                 view(spark, sf_dir, "reputation"), view(spark, sf_dir, "dkim"), _as_of())


@query("n11_sender_score", build(
    "SELECT mail_id, sender, age_risk, round(reputation_risk, 6) AS reputation_risk, typo_risk, spf_risk, dmarc_risk, dkim_risk, alignment_risk, "
    "round(sender_risk, 6) AS sender_risk FROM sender_score", "sender_score"))
def n11(spark, sf_dir):
    return scored_senders(spark, sf_dir).select(
        "mail_id", "sender", "age_risk", r6("reputation_risk").alias("reputation_risk"), "typo_risk", "spf_risk", "dmarc_risk",
        "dkim_risk", "alignment_risk", r6("sender_risk").alias("sender_risk"))


_EXEMPT = "(" + " OR ".join(f"ends_with(dom, '{t}')" for t in rules.SENDER_TRUSTED) + ")"
_BRAND = [f"contains(dom, '{b}') AND NOT ends_with(dom, '.{b}.com') AND NOT {_EXEMPT}" for b in rules.LITE_BRANDS]
block("lite_sender", f"""
SELECT mail_id, address, CASE WHEN dom IS NULL THEN {d(0.8)} ELSE {' + '.join(f'CASE WHEN {c} THEN {d(0.4)} ELSE {d(0)} END' for c in _BRAND)}
    + age + CASE WHEN NOT has_mx THEN {d(0.3)} ELSE {d(0)} END END AS lite_sender_risk,
  CASE WHEN dom IS NULL THEN ['Invalid sender email format'] ELSE {compact(
      [case(c, lit(f'Possible typosquatting of {b}')) for b, c in zip(rules.LITE_BRANDS, _BRAND)]
      + [case('age = 0.3', "'Domain is less than 14 days old'"), case('age = 0.15', "'Domain is relatively new (14-30 days old)'"),
         case('age = 0.1', "'Could not verify domain age'"), case('NOT has_mx', "'No valid MX records'")])} END AS factors
FROM (SELECT a.*, CASE WHEN w.ok AND w.creation_dates[1] IS NULL THEN {d(0)} WHEN w.ok THEN CASE WHEN floor((epoch({AS_OF}) - epoch(w.creation_dates[1])) / 86400) < 14 THEN {d(0.3)}
      WHEN floor((epoch({AS_OF}) - epoch(w.creation_dates[1])) / 86400) < 30 THEN {d(0.15)} ELSE {d(0)} END ELSE {d(0.1)} END AS age,
    a.dom IN (SELECT domain FROM mx) AS has_mx
  FROM (SELECT mail_id, address, CASE WHEN contains(address, '@') THEN lower(split_part(address, '@', 2)) END AS dom
        FROM (SELECT mail_id, {_ADDRESS} AS address FROM mail)) a LEFT JOIN whois w ON w.domain = a.dom)""", "mail", "whois", "mx")


@query("n12_lite_sender", build(
    "SELECT mail_id, address AS sender, round(lite_sender_risk, 6) AS lite_sender_risk, array_to_string(factors, ' | ') AS factors FROM lite_sender", "lite_sender"))
def n12(spark, sf_dir):
    mail = view(spark, sf_dir, "mail").selectExpr("mail_id", f"{_ADDRESS} AS sender")
    df = senders.lite_sender(mail, view(spark, sf_dir, "whois"), view(spark, sf_dir, "mx"), _as_of())
    return df.select("mail_id", "sender", r6("lite_sender_risk").alias("lite_sender_risk"), joined("lite_sender_factors").alias("factors"))


def _contains(text, words):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


FACTS = f"""domain IN {in_list(rules.KNOWN_SENDER_DOMAINS)} AS is_known_sender, domain NOT IN {in_list(rules.FREE_MAIL_DOMAINS)} AS is_business_domain,
  CASE {' '.join(f"WHEN domain = '{k}' THEN '{v}'" for k, v in rules.SENDER_CATEGORY_EXACT)} {' '.join(f"WHEN contains(domain, '{k}') THEN '{v}'" for k, v in rules.SENDER_CATEGORY_PART)} ELSE 'unknown' END AS sender_category,
  CASE WHEN coalesce(subject, '') = '' THEN 'unknown' {' '.join(f"WHEN {_contains('lower(subject)', w)} THEN '{n}'" for n, w in rules.MAIL_TYPES)} ELSE 'general' END AS email_type"""


@query("n13_sender_facts", build(f"SELECT mail_id, {FACTS} FROM mail", "mail"))
def n13(spark, sf_dir):
    return senders.sender_facts(view(spark, sf_dir, "mail")).select(
        "mail_id", "is_known_sender", "is_business_domain", "sender_category", "email_type")


# ---- behaviour --------------------------------------------------------------------
block("hours", "SELECT sender, extract('hour' FROM timestamp) AS hour, count(*) AS n FROM history GROUP BY ALL", "history")
block("time_risk", f"""
SELECT mail_id, why AS time_reason, CASE WHEN hr IS NULL THEN NULL WHEN starts_with(why, 'Late') THEN {d(0.7)} WHEN why = 'Weekend' THEN {d(0.5)} WHEN why IS NOT NULL THEN {d(0.6)} ELSE {d(0)} END AS time_risk
FROM (SELECT m.mail_id, m.hr, CASE WHEN m.hr IS NULL THEN NULL WHEN m.hr >= 22 OR m.hr <= 5 THEN 'Late night/early morning' WHEN isodow(m.local_ts) >= 6 THEN 'Weekend'
    WHEN m.sender IN (SELECT sender FROM hours) AND coalesce(h.n, 0) < 2 THEN 'Unusual time for this sender' END AS why
  FROM (SELECT *, extract('hour' FROM local_ts) AS hr FROM meta) m LEFT JOIN hours h ON h.sender = m.sender AND h.hour = m.hr)""", "meta", "hours")


@query("b1_sending_time", build("SELECT mail_id, time_reason, time_risk FROM time_risk", "time_risk"))
def b1(spark, sf_dir):
    mail = header_metadata(view(spark, sf_dir, "mail"))
    return behavior.sending_time(mail, view(spark, sf_dir, "history")).select("mail_id", "time_reason", "time_risk")


block("geo", f"""
SELECT m.mail_id, m.origin_ip, min(g.country) AS origin_country, CASE WHEN min(g.country) IN {in_list(rules.HIGH_RISK_COUNTRIES)} THEN {d(0.8)} ELSE {d(0)} END AS geo_risk
FROM (SELECT mail_id, origin_ip, CAST(split_part(origin_ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(origin_ip, '.', 2) AS BIGINT) * 65536
    + CAST(split_part(origin_ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(origin_ip, '.', 4) AS BIGINT) AS num FROM meta) m
LEFT JOIN ip_geo g ON m.num BETWEEN g.lo AND g.hi GROUP BY m.mail_id, m.origin_ip""", "meta", "ip_geo")


@query("b2_geographic_origin", build("SELECT mail_id, origin_ip, origin_country, geo_risk FROM geo", "geo"))
def b2(spark, sf_dir):
    mail = header_metadata(view(spark, sf_dir, "mail"))
    return behavior.geographic_origin(mail, view(spark, sf_dir, "ip_geo")).select("mail_id", "origin_ip", "origin_country", "geo_risk")


_RISK = "CASE WHEN n = 0 THEN {0} WHEN p > 0 THEN {1} ELSE greatest({2}, {3} - {2} * least(n, 4)) END".format(d(0.6), d(0.9), d(0.1), d(0.5))


_PAIRS = build(f"""
SELECT id, sender, recipient, n AS prior_n, n = 0 AS is_first_contact, round(CASE WHEN n > 1 THEN g / CAST(n - 1 AS DOUBLE) END, 6) AS average_interval_days, round({_RISK}, 6) AS history_risk
FROM (SELECT *, count(*) OVER w AS n, coalesce(max(is_phishing) OVER w, 0) AS p, coalesce(sum(gap) OVER w, 0) AS g
  FROM (SELECT *, floor((epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY sender, recipient ORDER BY timestamp, id))) / 86400000000) AS gap FROM history)
  WINDOW w AS (PARTITION BY sender, recipient ORDER BY timestamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""", "history")
_PAIR_COLUMNS = ("id", "sender", "recipient", "prior_n", "is_first_contact")


@query("b3_pair_history", _PAIRS)
def b3(spark, sf_dir):
    return behavior.pair_history(view(spark, sf_dir, "history")).select(
        *_PAIR_COLUMNS, r6("average_interval_days").alias("average_interval_days"), r6("history_risk").alias("history_risk"))


# the same with every pair of more than 20 mails treated as a hot one
@query("b3_pair_history_hot", _PAIRS)
def b3_hot(spark, sf_dir):
    return behavior.pair_history(view(spark, sf_dir, "history"), hot_rows=20).select(
        *_PAIR_COLUMNS, r6("average_interval_days").alias("average_interval_days"), r6("history_risk").alias("history_risk"))


_OWN = "nullif(regexp_extract(headers, '(?im)^From:[ \\t]*(?:[^<\\n]*<)?([^>\\n]+)>?', 1), '')"
block("consist", f"""
SELECT mail_id, {compact([case('own <> return_path', "'From (' || own || ') doesn''t match Return-Path (' || return_path || ')'"),
                          case('own <> reply_to', "'From (' || own || ') doesn''t match Reply-To (' || reply_to || ')'"),
                          case('nrec > 7', "'Unusually long Received chain (' || CAST(nrec AS VARCHAR) || ' hops)'")])} AS inconsistencies,
  greatest({d(0)}, CASE WHEN own <> return_path THEN {d(0.7)} ELSE {d(0)} END, CASE WHEN own <> reply_to THEN {d(0.8)} ELSE {d(0)} END, CASE WHEN nrec > 7 THEN {d(0.6)} ELSE {d(0)} END) AS consistency_risk
FROM (SELECT *, {_OWN} AS own, len(regexp_extract_all(headers, 'Received:')) AS nrec FROM meta)""", "meta")


@query("b4_header_consistency", build("SELECT mail_id, array_to_string(inconsistencies, ' | ') AS inconsistencies, consistency_risk FROM consist", "consist"))
def b4(spark, sf_dir):
    return behavior.header_consistency(view(spark, sf_dir, "mail")).select("mail_id", joined("inconsistencies").alias("inconsistencies"), "consistency_risk")


B = rules.BEHAVIOR_WEIGHTS
block("behavior", f"""
SELECT *, behavior_risk > 0.6 AS behavior_suspicious FROM (
SELECT m.mail_id, t.time_risk, g.geo_risk, h.history_risk, c.consistency_risk,
  least({d(1)}, round((coalesce(t.time_risk * {d(B['sending_time'])}, 0) + g.geo_risk * {d(B['geographic_origin'])} + h.history_risk * {d(B['sender_history'])} + c.consistency_risk * {d(B['header_consistency'])})
   / (CASE WHEN t.time_risk IS NULL THEN {d(0)} ELSE {d(B['sending_time'])} END + {d(0.8)}), 9)) AS behavior_risk
FROM mail m JOIN time_risk t ON t.mail_id = m.mail_id JOIN geo g ON g.mail_id = m.mail_id JOIN consist c ON c.mail_id = m.mail_id
JOIN (SELECT mail_id, {_RISK} AS history_risk FROM (SELECT m.mail_id, coalesce(p.n, 0) AS n, coalesce(p.p, 0) AS p FROM mail m LEFT JOIN
   (SELECT sender, recipient, count(*) AS n, max(is_phishing) AS p FROM history GROUP BY ALL) p ON p.sender = m.sender AND p.recipient = m.recipient)) h ON h.mail_id = m.mail_id)""",
      "mail", "time_risk", "geo", "consist", "history")


@query("b5_behavior_score", build("SELECT mail_id, time_risk, geo_risk, round(history_risk, 6) AS history_risk, consistency_risk, round(behavior_risk, 6) AS behavior_risk, behavior_suspicious FROM behavior", "behavior"))
def b5(spark, sf_dir):
    df = behavior.score_behavior(view(spark, sf_dir, "mail"), view(spark, sf_dir, "history"), view(spark, sf_dir, "ip_geo"))
    return df.select("mail_id", "time_risk", "geo_risk", r6("history_risk").alias("history_risk"), "consistency_risk", r6("behavior_risk").alias("behavior_risk"), "behavior_suspicious")


@query("b6_history_append", build(f"""
SELECT id AS mail_id, sender, recipient, n AS prior_n, p AS prior_phishing, round({_RISK}, 6) AS history_risk FROM (
  SELECT *, count(*) OVER w AS n, coalesce(max(is_phishing) OVER w, 0) AS p FROM (
    SELECT id, sender, recipient, timestamp, is_phishing, false AS is_new FROM history
    UNION ALL SELECT mail_id, sender, recipient, sent_at, 0, true FROM mail)
  WINDOW w AS (PARTITION BY sender, recipient ORDER BY timestamp, is_new, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE is_new""", "history", "mail"))
def b6(spark, sf_dir):
    df = behavior.score_appended(view(spark, sf_dir, "history"), view(spark, sf_dir, "mail"))
    return df.withColumn("history_risk", r6("history_risk"))


@query("b7_hour_histogram", build("SELECT sender, " + ", ".join(f"coalesce(sum(n) FILTER (WHERE hour = {h}), 0)::BIGINT AS h{h:02d}" for h in range(24)) + " FROM hours GROUP BY sender", "hours"))
def b7(spark, sf_dir):
    return behavior.hour_histogram(view(spark, sf_dir, "history"))
