"""Link queries (U rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailglass import rules
from mailglass.functions import url as U
from mailglass.operators import urls as ops
from mailglass.plans.bindings import view
from mailglass.plans.oracle_base import HOST_ONLY, NETLOC, WITH_PATH, block, build, d, parts
from mailglass.plans.registry import joined, query, r6


def _urls(spark, sf_dir):
    return view(spark, sf_dir, "urls").withColumnRenamed("url", "raw_url")


def _known(spark, sf_dir):
    return U.suffix_rules(view(spark, sf_dir, "suffixes"))


def _hops(spark, sf_dir):
    return ops.prepare_hops(view(spark, sf_dir, "redirects"), suffixes=_known(spark, sf_dir))


@query("u1_extract_links", build("SELECT mail_id, CAST(pos AS INTEGER) AS pos, raw_url FROM links", "links"))
def u1(spark, sf_dir):
    return ops.mail_links(view(spark, sf_dir, "mail"))


@query("u2_simple_scan", build(
    f"SELECT mail_id, 'path' AS dialect, unnest(regexp_extract_all(raw, {WITH_PATH})) AS link FROM mail "
    f"UNION ALL SELECT mail_id, 'host', unnest(regexp_extract_all(raw, {HOST_ONLY})) FROM mail", "mail"))
def u2(spark, sf_dir):
    mail = view(spark, sf_dir, "mail")
    both = F.concat(
        F.transform(U.scan_urls(F.col("raw")), lambda x: F.struct(F.lit("path").alias("dialect"), x.alias("link"))),
        F.transform(U.scan_urls(F.col("raw"), host_only=True), lambda x: F.struct(F.lit("host").alias("dialect"), x.alias("link"))))
    return mail.select("mail_id", F.explode(both).alias("hit")).select("mail_id", "hit.dialect", "hit.link")


block("url_raw_p", parts("(SELECT url AS raw_url FROM urls)", "raw_url"), "urls")


@query("u3_host_split", build(
    "SELECT raw_url, scheme, netloc, host, port, path, query, suffix, domain, subdomain, registered_domain FROM url_raw_p", "url_raw_p"))
def u3(spark, sf_dir):
    return U.with_parts(_urls(spark, sf_dir), "raw_url", _known(spark, sf_dir)).select(
        "raw_url", "scheme", "netloc", "host", "port", "path", "query", "suffix", "domain", "subdomain", "registered_domain")


@query("u4_normalize", build("SELECT raw_url, url FROM url_n", "url_n"))
def u4(spark, sf_dir):
    return U.with_normalized(_urls(spark, sf_dir), "raw_url", "url")


@query("u5_domain_rules", build(
    "SELECT raw_url, dom_suspicious, array_to_string(dom_reasons, ' | ') AS dom_reasons, round(dom_risk, 6) AS dom_risk FROM url_d", "url_d"))
def u5(spark, sf_dir):
    df = U.domain_rules(U.with_parts(U.with_normalized(_urls(spark, sf_dir), "raw_url", "url"), suffixes=_known(spark, sf_dir)))
    return df.select("raw_url", "dom_suspicious", joined("dom_reasons").alias("dom_reasons"), r6("dom_risk").alias("dom_risk"))


@query("u6_structure_rules", build(
    "SELECT raw_url, str_suspicious, array_to_string(str_reasons, ' | ') AS str_reasons, round(str_risk, 6) AS str_risk FROM url_s", "url_s"))
def u6(spark, sf_dir):
    df = U.structure_rules(U.with_parts(U.with_normalized(_urls(spark, sf_dir), "raw_url", "url"), suffixes=_known(spark, sf_dir)))
    return df.select("raw_url", "str_suspicious", joined("str_reasons").alias("str_reasons"), r6("str_risk").alias("str_risk"))


@query("u7_redirect_chains", build(
    "SELECT url, final_url, CAST(chain_length AS INTEGER) AS chain_length, red_suspicious, round(red_risk, 6) AS red_risk, "
    "array_to_string(red_reasons, ' | ') AS red_reasons FROM url_chain", "url_chain"))
def u7(spark, sf_dir):
    starts = U.with_normalized(_urls(spark, sf_dir), "raw_url", "url").select("url").distinct()
    df = ops.redirect_chains(starts, _hops(spark, sf_dir))
    return df.select("url", "final_url", "chain_length", "red_suspicious", r6("red_risk").alias("red_risk"),
                     joined("red_reasons").alias("red_reasons"))


@query("u8_hop_pairs", build("SELECT src, dst, pair_suspicious FROM hops", "hops"))
def u8(spark, sf_dir):
    return _hops(spark, sf_dir).select("src", "dst", "pair_suspicious")


@query("u9_link_verdict", build(
    "SELECT raw_url, url, CAST(chain_length AS INTEGER) AS chain_length, suspicious, round(risk, 6) AS risk, "
    "array_to_string(reasons, ' | ') AS reasons FROM url_verdicts", "url_verdicts"))
def u9(spark, sf_dir):
    links = _urls(spark, sf_dir).withColumns({"mail_id": F.xxhash64("raw_url"), "pos": F.lit(0)})
    return ops.link_verdicts(links, _hops(spark, sf_dir), suffixes=_known(spark, sf_dir)).select(
        "raw_url", "url", "chain_length", "suspicious", r6("risk").alias("risk"), joined("reasons").alias("reasons"))


def verdicts(spark, sf_dir):
    return ops.link_verdicts(ops.mail_links(view(spark, sf_dir, "mail"), keep_empty=True), _hops(spark, sf_dir), suffixes=_known(spark, sf_dir))


@query("u10_mail_link_rollup", build(
    "SELECT mail_id, total_urls, suspicious_urls, unique_domains, shortener_count, redirect_count, round(url_risk, 6) AS url_risk, "
    f"round(CASE WHEN total_urls > 0 THEN CAST(suspicious_urls AS DOUBLE) / total_urls * 100 ELSE {d(0)} END, 6) AS suspicious_share, "
    "suspicious_urls > 0 OR unique_domains > 2 OR shortener_count > 1 OR redirect_count > 2 AS url_suspicious FROM url_rollup", "url_rollup"))
def u10(spark, sf_dir):
    return ops.roll_up_links(verdicts(spark, sf_dir)).select(
        "mail_id", "total_urls", "suspicious_urls", "unique_domains", "shortener_count", "redirect_count",
        r6("url_risk").alias("url_risk"), r6("suspicious_share").alias("suspicious_share"), "url_suspicious")


@query("u11_repeated_reasons", build(
    "SELECT mail_id, reason, count(*) AS n FROM (SELECT mail_id, unnest(reasons) AS reason FROM verdicts WHERE suspicious) "
    "GROUP BY mail_id, reason HAVING count(*) > 1", "verdicts"))
def u11(spark, sf_dir):
    return ops.repeated_reasons(verdicts(spark, sf_dir))


_LITE = " + ".join(
    [f"CASE WHEN contains(host, '{b}') AND NOT ends_with(host, '.{b}.com') THEN {d(0.4)} ELSE {d(0)} END" for b in rules.LITE_BRANDS]
    + ["CASE WHEN " + " OR ".join(f"ends_with(host, '{t}')" for t in rules.LITE_TLDS) + f" THEN {d(0.3)} ELSE {d(0)} END",
       rf"CASE WHEN regexp_matches(host, '\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}') THEN {d(0.4)} ELSE {d(0)} END"])
block("lite_pos", f"SELECT mail_id, pos, link, {_LITE} AS link_risk FROM (SELECT mail_id, pos, link, lower(regexp_extract(link, {NETLOC}, 1)) AS host "
      f"FROM (SELECT mail_id, unnest(ls) AS link, generate_subscripts(ls, 1) AS pos FROM (SELECT mail_id, regexp_extract_all(raw, {WITH_PATH}) AS ls FROM mail)))", "mail")
block("lite_links", "SELECT mail_id, link, link_risk FROM lite_pos", "lite_pos")
block("lite_rollup", "SELECT m.mail_id, count(l.link) AS urls_found, count(*) FILTER (WHERE l.link_risk > 0) AS risky_urls, "
      f"coalesce(max(l.link_risk), {d(0)}) AS lite_url_risk FROM mail m LEFT JOIN lite_links l ON l.mail_id = m.mail_id GROUP BY m.mail_id",
      "mail", "lite_links")


@query("u12_lite_link_score", build(
    "SELECT mail_id, urls_found, risky_urls, round(lite_url_risk, 6) AS lite_url_risk FROM lite_rollup", "lite_rollup"))
def u12(spark, sf_dir):
    return ops.lite_mail_score(view(spark, sf_dir, "mail")).select(
        "mail_id", "urls_found", "risky_urls", r6("lite_url_risk").alias("lite_url_risk"))


@query("u13_mean_risk_rollup", build(
    f"SELECT m.mail_id, round(coalesce(a.mean_risk, {d(0)}), 6) AS mean_risk, coalesce(b.reasons, '') AS reasons, coalesce(a.mean_risk, 0) > 0.5 AS suspicious "
    "FROM mail m LEFT JOIN (SELECT mail_id, avg(risk) AS mean_risk FROM verdicts WHERE suspicious GROUP BY mail_id) a ON a.mail_id = m.mail_id "
    "LEFT JOIN (SELECT mail_id, array_to_string(list_sort(list(DISTINCT reason)), ' | ') AS reasons FROM "
    "(SELECT mail_id, unnest(reasons) AS reason FROM verdicts WHERE suspicious) GROUP BY mail_id) b ON b.mail_id = m.mail_id", "mail", "verdicts"))
def u13(spark, sf_dir):
    return ops.mean_risk_rollup(verdicts(spark, sf_dir)).select(
        "mail_id", r6("mean_risk").alias("mean_risk"), joined("reasons").alias("reasons"), "suspicious")


_KEY = " OR ".join(f"contains(link, '{k}')" for k in rules.ELEMENT_URL_KEYWORDS)


@query("u14_link_elements", build(
    "SELECT mail_id, 'url' AS type, 'Suspicious URL: ' || link AS description, CAST(CASE WHEN "
    rf"regexp_matches(link, '^https?://\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}') THEN 0.95 WHEN {_KEY} THEN 0.85 ELSE 0.7 END AS DOUBLE) AS risk_score "
    f"FROM (SELECT mail_id, unnest(regexp_extract_all(raw, {HOST_ONLY})) AS link FROM mail)", "mail"))
def u14(spark, sf_dir):
    return ops.link_elements(view(spark, sf_dir, "mail")).drop("pos")


@query("u15_link_context", build(
    "SELECT mail_id, raw_url, CASE WHEN p > start THEN substr(w, 1, p - start) || '[' || substr(w, p - start + 1, length(raw_url)) || ']' || "
    "substr(w, p - start + length(raw_url) + 1) ELSE w END AS context FROM (SELECT *, "
    r"regexp_replace(substr(raw, start + 1, p - start + length(raw_url) + 50), '^\s+|\s+$', '', 'g') AS w "
    "FROM (SELECT *, greatest(0, p - 50) AS start FROM (SELECT *, position(raw_url IN raw) - 1 AS p FROM links)))", "links"))
def u15(spark, sf_dir):
    mail = view(spark, sf_dir, "mail")
    links = mail.select("mail_id", "raw", F.explode(U.extract_urls(F.col("raw"))).alias("raw_url"))
    return ops.link_context(links).select("mail_id", "raw_url", "context")
