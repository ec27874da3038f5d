"""Building blocks of the check SQL (DuckDB dialect).

The check engine re-derives each result from the raw driver tables on its own:
named blocks are common table expressions that list the blocks they need, and
:func:`build` strings the needed ones together.
"""

from __future__ import annotations

from mailglass import rules
from mailglass.plans import bindings
from mailglass.plans.bindings import SUFFIX_RULES

BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {
    name: ((), bindings.cte(name)) for name in bindings.VIEWS
}


def block(name: str, sql: str, *needs: str) -> None:
    BLOCKS[name] = (needs, sql)


def build(select: str, *needs: str, using: dict[str, tuple[tuple[str, ...], str]] | None = None):
    """Check SQL over the named blocks, put together once all are defined;
    ``using`` has blocks that stand in for those of their name."""
    return lambda: resolve(select, *needs, using=using)


def resolve(select: str, *needs: str, using: dict[str, tuple[tuple[str, ...], str]] | None = None) -> str:
    order: list[str] = []
    blocks = {**BLOCKS, **(using or {})}

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in blocks[name][0]:
            visit(dep)
        order.append(name)

    for name in needs:
        visit(name)
    head = ",\n".join(f"{n} AS ({blocks[n][1]})" for n in order)
    return f"WITH RECURSIVE {head}\n{select}" if order else select


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def str_list(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def compact(items) -> str:
    """List of the non-null items; items are SQL expressions."""
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"


def case(cond: str, value: str) -> str:
    return f"CASE WHEN {cond} THEN {value} END"


def d(value: float) -> str:
    return f"CAST({value} AS DOUBLE)"


def hits(items) -> str:
    """List of {reason, risk} for (condition, reason SQL, risk) items."""
    return compact(case(c, f"{{'reason': {r}, 'risk': {d(s)}}}") for c, r, s in items)


# ---- mail -----------------------------------------------------------------------
block("hdr", "SELECT *, regexp_replace(head, '\\n[ \\t]+', ' ', 'g') AS headers FROM (SELECT *, split_part(raw, chr(10) || chr(10), 1) AS head, "
      "CASE WHEN position(chr(10) || chr(10) IN raw) > 0 THEN substr(raw, position(chr(10) || chr(10) IN raw) + 2) ELSE raw END AS body "
      "FROM (SELECT * REPLACE (replace(raw, chr(13) || chr(10), chr(10)) AS raw) FROM mail))", "mail")


def header(name: str) -> str:
    return f"nullif(trim(regexp_extract(headers, '(?im)^{name}:[ \\t]*(.*)$', 1)), '')"


_WORD = r"'=\?[^?\s]+\?[BbQq]\?[^?\s]*\?='"
_HEX = (r"CASE lower(split_part(w, '?', 3)) WHEN 'b' THEN hex(from_base64(split_part(w, '?', 4))) ELSE array_to_string("
        r"list_transform(regexp_extract_all(replace(split_part(w, '?', 4), '_', ' '), '=[0-9A-Fa-f]{2}|.'), lambda t: CASE WHEN length(t) = 3 THEN upper(t[2:3]) ELSE hex(t) END), '') END")
_CODES = "list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2) AS INTEGER))"
# the 32 places at which this charset differs from Latin-1
_CP1252 = str_list(bytes(range(128, 160)).decode("windows-1252", "replace"))


def decoded(value: str) -> str:
    """A header value's SQL with encoded words decoded (Unicode, Latin-1, windows-1252)."""
    latin = f"array_to_string(list_transform({_CODES}, lambda c: chr(c)), '')"
    windows = f"array_to_string(list_transform({_CODES}, lambda c: CASE WHEN c BETWEEN 128 AND 159 THEN {_CP1252}[c - 127] ELSE chr(c) END), '')"
    word = (f"list_transform(list_transform(regexp_extract_all(v, {_WORD}), lambda w: {{'c': lower(split_part(w, '?', 2)), 'h': {_HEX}}}), "
            f"lambda x: CASE x.c WHEN 'utf-8' THEN decode(unhex(x.h)) WHEN 'iso-8859-1' THEN {latin.replace('(h)', '(x.h)').replace('substr(h,', 'substr(x.h,')} "
            f"ELSE {windows.replace('(h)', '(x.h)').replace('substr(h,', 'substr(x.h,')} END)")
    return (f"(SELECT CASE WHEN v IS NULL THEN NULL ELSE array_to_string(flatten(list_transform(list_zip(regexp_split_to_array(v, {_WORD}), {word}), lambda z: [z[1], coalesce(z[2], '')])), '') END "
            f"FROM (SELECT regexp_replace({value}, '(\\?=)\\s+(=\\?[^?\\s]+\\?[BbQq]\\?)', '\\1\\2', 'g') AS v))")


HEADER_FROM = f"nullif(regexp_extract({decoded(header('From'))}, '^(?:[^<]*<)?([^>]+)>?', 1), '')"
RECEIVED = r"'Received:\s+from\s+([^\s\[\]]+)(?:\s+\(?\[([^\]]+)\])?'"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
block("meta0", f"""
SELECT *, nullif(regexp_extract(headers, '(?m)^Date:\\s*(?:[A-Za-z]{{3}},\\s+)?(\\d{{1,2}}\\s+[A-Za-z]{{3}}\\s+\\d{{4}}\\s+\\d{{1,2}}:\\d{{1,2}}:\\d{{1,2}}\\s+[+-]\\d{{4}})', 1), '') AS date_text,
  regexp_extract_all(headers, {RECEIVED}, 1) AS received_domains,
  list_filter(regexp_extract_all(headers, {RECEIVED}, 2), lambda x: x IS NOT NULL AND x <> '') AS received_ips,
  nullif(regexp_extract(headers, '(?m)^Return-Path:\\s*<([^>]+)>', 1), '') AS return_path,
  nullif(regexp_extract(headers, '(?m)^Reply-To:\\s*<?([^>\\s]+)>?', 1), '') AS reply_to,
  {decoded(header('X-Mailer'))} AS x_mailer
FROM hdr""", "hdr")
block("meta", """
SELECT *, nullif(regexp_extract(date_text, '([+-]\\d{4})$', 1), '') AS zone,
  CASE WHEN date_text IS NOT NULL THEN make_timestamp(
    CAST(regexp_extract(date_text, '(\\d{4}) \\d', 1) AS BIGINT),
    CAST(list_position([%s], regexp_extract(date_text, '([A-Za-z]{3})', 1)) AS BIGINT),
    CAST(regexp_extract(date_text, '^(\\d{1,2})', 1) AS BIGINT),
    CAST(regexp_extract(date_text, '(\\d{1,2}):', 1) AS BIGINT),
    CAST(regexp_extract(date_text, ':(\\d{1,2}):', 1) AS BIGINT),
    CAST(regexp_extract(date_text, ':(\\d{1,2}) ', 1) AS DOUBLE)) END AS local_ts,
  received_ips[-1] AS origin_ip
FROM meta0""" % ", ".join(lit(m) for m in MONTHS), "meta0")

# ---- links ----------------------------------------------------------------------
HREF = r"'href=[\x22\x27](https?://[^\x22\x27>]+)[\x22\x27]'"
BARE = r"'(https?://[^\s<>\x22\x27]+)'"
WITH_PATH = r"'https?://(?:[-\p{L}\p{N}_.]|(?:%[\da-fA-F]{2}))+[^\s]*'"
HOST_ONLY = r"'https?://(?:[-\p{L}\p{N}_.]|(?:%[\da-fA-F]{2}))+'"
block("mail_urls", rf"""
SELECT mail_id, raw, list_filter(us, lambda x, i: list_position(us, x) = i) AS us FROM (
  SELECT mail_id, raw, list_concat(regexp_extract_all(raw, {HREF}, 1),
    regexp_extract_all(regexp_replace(raw, '(href=[\x22\x27])https?://', '\1', 'g'), {BARE}, 1)) AS us
  FROM mail)""", "mail")
block("links", "SELECT mail_id, raw, unnest(us) AS raw_url, generate_subscripts(us, 1) - 1 AS pos FROM mail_urls", "mail_urls")
SCHEME = r"'^([A-Za-z][A-Za-z0-9+.-]*)://'"
NETLOC = r"'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)'"
PATH = r"'^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)'"
PAIRS = ("[{'k': url_decode(replace(regexp_extract(p, '^([^=]*)=', 1), '+', ' ')), "
         "'v': url_decode(replace(regexp_extract(p, '^[^=]*=(.+)$', 1), '+', ' '))} "
         "for p in string_split(%s, '&') if regexp_matches(p, '^[^=]*=.+')]")


def normalized(source: str, column: str, alias: str) -> str:
    """Rows of ``source`` with the normalised form of a column."""
    return f"""
SELECT * EXCLUDE (n_full, n_auth, n_pairs), url_decode(
  lower(regexp_extract(n_full, {SCHEME}, 1)) || '://' ||
  CASE WHEN (lower(regexp_extract(n_full, {SCHEME}, 1)) = 'http' AND regexp_matches(n_auth, '^[^:]*:80$'))
         OR (lower(regexp_extract(n_full, {SCHEME}, 1)) = 'https' AND regexp_matches(n_auth, '^[^:]*:443$'))
       THEN split_part(n_auth, ':', 1) ELSE n_auth END ||
  lower(regexp_extract(n_full, {PATH}, 1)) ||
  CASE WHEN len(n_pairs) > 0 THEN '?' || array_to_string(
    [kk || '=' || array_to_string(list_sort([x.v for x in n_pairs if x.k = kk]), ',')
     for kk in list_sort(list_distinct([y.k for y in n_pairs]))], '&') ELSE '' END) AS {alias}
FROM (SELECT *, lower(regexp_extract(n_full, {NETLOC}, 1)) AS n_auth,
        {PAIRS % "regexp_extract(n_full, '^[^?#]*[?]([^#]*)', 1)"} AS n_pairs
      FROM (SELECT *, CASE WHEN starts_with({column}, 'http://') OR starts_with({column}, 'https://')
                           THEN {column} ELSE 'http://' || {column} END AS n_full FROM {source}))"""


def parts(source: str, column: str) -> str:
    """Rows of ``source`` with scheme, netloc, host split, port, path, query."""
    plain = in_list(r for r in SUFFIX_RULES if r[0] not in "*!")
    wildcard = in_list(r[2:] for r in SUFFIX_RULES if r[0] == "*")
    exception = in_list(r[1:] for r in SUFFIX_RULES if r[0] == "!")
    ip = r"regexp_matches(host, '^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$')"
    return f"""
SELECT * EXCLUDE (tails), CASE WHEN domain <> '' AND suffix <> '' THEN domain || '.' || suffix ELSE '' END AS registered_domain,
  CASE WHEN length(host) > length(domain) + CASE WHEN suffix = '' THEN 0 ELSE length(suffix) + 1 END
       THEN substr(host, 1, length(host) - length(domain) - CASE WHEN suffix = '' THEN 0 ELSE length(suffix) + 1 END - 1)
       ELSE '' END AS subdomain
FROM (SELECT *, CASE WHEN {ip} THEN host WHEN suffix = '' THEN string_split(host, '.')[-1]
                     WHEN host = suffix THEN '' ELSE string_split(substr(host, 1, length(host) - length(suffix) - 1), '.')[-1] END AS domain
  FROM (SELECT *, CASE WHEN {ip} THEN '' ELSE coalesce(
          [substr(t, strpos(t, '.') + 1) for t in tails if t IN {exception}][1],
          [t for t in tails if t IN {plain} OR (contains(t, '.') AND substr(t, strpos(t, '.') + 1) IN {wildcard})][1],
          CASE WHEN contains(host, '.') THEN string_split(host, '.')[-1] END, '') END AS suffix
    FROM (SELECT *, [array_to_string(string_split(host, '.')[i:], '.') for i in range(1, len(string_split(host, '.')) + 1)] AS tails
    FROM (SELECT *, lower(regexp_extract(netloc, '^(?:[^@]*@)?([^:]*)', 1)) AS host,
            TRY_CAST(nullif(regexp_extract(netloc, ':([0-9]{{1,5}})$', 1), '') AS INTEGER) AS port
      FROM (SELECT *, lower(regexp_extract({column}, {SCHEME}, 1)) AS scheme, regexp_extract({column}, {NETLOC}, 1) AS netloc,
              regexp_extract({column}, {PATH}, 1) AS path, regexp_extract({column}, '^[^?#]*[?]([^#]*)', 1) AS query
            FROM {source})))))"""


def domain_rules(source: str) -> str:
    look = "coalesce(" + ", ".join(
        f"CASE WHEN registered_domain <> '' AND registered_domain <> {lit(t)} AND levenshtein(registered_domain, {lit(t)}) <= 2 THEN {lit('Possible typosquatting of ' + t)} END"
        for t in rules.URL_TRUSTED) + ")"
    items = [
        (f"netloc IN {in_list(rules.URL_SHORTENERS)}", "'URL shortener detected'", 0.6),
        (f"suffix IN {in_list(rules.SUSPICIOUS_TLDS)}", "'Suspicious TLD: .' || suffix", 0.7),
        (r"regexp_matches(netloc, '^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$')", "'IP address used as domain'", 0.9),
        (f"{look} IS NOT NULL", look, 0.8),
        ("subdomain <> '' AND len(string_split(subdomain, '.')) > 3", "'Excessive number of subdomains'", 0.6),
        ("port IS NOT NULL AND port <> 0 AND port NOT IN (80, 443)", "'Unusual port: ' || CAST(port AS VARCHAR)", 0.7),
        *[(f"contains(lower(domain), '{k}')", f"'Suspicious keyword in domain: {k}'", 0.6) for k in rules.DOMAIN_KEYWORDS],
        ("length(domain) - length(replace(domain, '-', '')) > 2", "'Excessive hyphens in domain'", 0.5),
    ]
    return f"""
SELECT * EXCLUDE (dh, trusted), NOT trusted AND len(dh) > 0 AS dom_suspicious,
  CASE WHEN trusted THEN ['Trusted domain'] ELSE [h.reason for h in dh] END AS dom_reasons,
  CASE WHEN trusted THEN {d(0.1)} ELSE coalesce(list_max([h.risk for h in dh]), {d(0)}) END AS dom_risk
FROM (SELECT *, {hits(items)} AS dh, (domain || '.' || suffix) IN {in_list(rules.URL_TRUSTED)} AS trusted FROM {source})"""


def structure_rules(source: str) -> str:
    pct = "(length(raw_url) - length(replace(raw_url, '%', '')))"
    labels = "(len(string_split(netloc, '.')) - 2)"
    head = hits([(f"{pct} > 3", f"'Excessive URL encoding (' || CAST({pct} AS VARCHAR) || ' instances)'", 0.6),
                 *[(f"regexp_matches(path, {lit(p)})", lit(f"Suspicious path pattern: {n}"), 0.7) for n, p in rules.PATH_PATTERNS]])
    tail = hits([(f"regexp_matches(regexp_extract(raw_url, {NETLOC}, 1), '[A-Z]')", "'Mixed case in domain'", 0.5),
                 (f"{labels} > 3", f"'Excessive subdomains (' || CAST({labels} AS VARCHAR) || ')'", 0.6)])
    return f"""
SELECT * EXCLUDE (sh), len(sh) > 0 AS str_suspicious, [h.reason for h in sh] AS str_reasons,
  coalesce(list_max([h.risk for h in sh]), {d(0)}) AS str_risk
FROM (SELECT * EXCLUDE (qp), list_concat(list_concat({head},
    [{{'reason': 'Suspicious parameter: ' || kk, 'risk': {d(0.6)}}} for kk in
       list_filter([y.k for y in qp], lambda x, i: list_position([z.k for z in qp], x) = i) if lower(kk) IN {in_list(rules.REDIRECT_PARAMS)}]),
    list_concat([{{'reason': 'URL found in parameter value', 'risk': {d(0.8)}}} for y in qp if contains(lower(url_decode(y.v)), 'http')],
    {tail})) AS sh
  FROM (SELECT *, {PAIRS % 'query'} AS qp FROM {source}))"""


block("links_n", normalized("links", "raw_url", "url"), "links")
block("links_p", parts("links_n", "url"), "links_n")
block("links_d", domain_rules("links_p"), "links_p")
block("links_s", structure_rules("links_d"), "links_d")

block("url_n", normalized("(SELECT url AS raw_url FROM urls)", "raw_url", "url"), "urls")
block("url_p", parts("url_n", "url"), "url_n")
block("url_d", domain_rules("url_p"), "url_p")
block("url_s", structure_rules("url_d"), "url_d")

# ---- redirects --------------------------------------------------------------------
block("hop_src", normalized("redirects", "src", "s"), "redirects")
block("hop_dst", normalized("hop_src", "dst", "t"), "hop_src")
block("hop1", """SELECT src, dst, kind, ssl_ok FROM (
  SELECT s AS src, t AS dst, kind, ssl_ok, row_number() OVER (PARTITION BY s ORDER BY t, kind, ssl_ok) AS rn FROM hop_dst) WHERE rn = 1""", "hop_dst")
block("hop_sp", "SELECT src, dst, kind, ssl_ok, scheme AS ss, port AS sp, registered_domain AS sr FROM (" + parts("hop1", "src") + ")", "hop1")
block("hop_dp", "SELECT * FROM (" + parts("hop_sp", "dst") + ")", "hop_sp")
_shaped = " OR ".join(f"regexp_matches(dst, {lit('(?i)' + p)})" for p in rules.REDIRECT_TARGET_PATTERNS)
_port = "coalesce({p}, CASE WHEN {s} = 'http' THEN 80 ELSE 443 END)"
PAIR = f"""((ss = 'https' AND scheme = 'http')
  OR ({_port.format(p='sp', s='ss')} <> {_port.format(p='port', s='scheme')}
      AND NOT (ss = 'http' AND scheme = 'https' AND sp IS NULL AND port IS NULL))
  OR (sr <> registered_domain AND registered_domain NOT IN {in_list(rules.URL_TRUSTED)})
  OR {_shaped})"""
block("hops", f"SELECT src, dst, kind, ssl_ok, {PAIR} AS pair_suspicious, dom_suspicious AS dst_suspicious, dom_risk AS dst_risk, dom_reasons AS dst_reasons FROM ("
      + domain_rules("hop_dp") + ")", "hop_dp")
N = rules.MAX_REDIRECTS
CHAIN = f"""
SELECT url, url AS cur, [url] AS chain, {d(0)} AS risk, false AS flagged, CAST([] AS VARCHAR[]) AS reasons, false AS done, 0 AS hop
FROM (SELECT DISTINCT url FROM %s) WHERE url IN (SELECT src FROM hops)
UNION ALL
SELECT url,
  CASE WHEN ssl_ok AND NOT seen THEN dst ELSE cur END,
  CASE WHEN ssl_ok AND NOT seen THEN list_append(chain, dst) ELSE chain END,
  greatest(risk, CASE WHEN NOT ssl_ok THEN {d(0.9)} ELSE {d(0)} END,
    CASE WHEN ssl_ok AND pair_suspicious THEN CASE kind WHEN 'http' THEN {d(0.7)} ELSE {d(0.8)} END ELSE {d(0)} END,
    CASE WHEN ssl_ok AND kind = 'http' AND seen THEN {d(0.8)} ELSE {d(0)} END,
    CASE WHEN ssl_ok AND kind = 'http' AND NOT seen AND dst_suspicious THEN dst_risk ELSE {d(0)} END),
  flagged OR NOT ssl_ok OR pair_suspicious OR (kind = 'http' AND seen) OR (kind = 'http' AND NOT seen AND dst_suspicious),
  list_concat(list_concat(reasons, {compact([
      case("ssl_ok AND pair_suspicious AND kind = 'http'", "'Suspicious redirect: ' || cur || ' -> ' || dst"),
      case("ssl_ok AND pair_suspicious AND kind = 'meta'", "'Suspicious meta refresh: ' || cur || ' -> ' || dst"),
      case("ssl_ok AND kind = 'http' AND seen", "'Redirect loop detected'"),
      case("NOT ssl_ok", "'SSL certificate validation failed: ' || cur")])}),
    CASE WHEN ssl_ok AND kind = 'http' AND NOT seen AND dst_suspicious THEN dst_reasons ELSE CAST([] AS VARCHAR[]) END),
  NOT (ssl_ok AND NOT seen), hop + 1
FROM (SELECT c.*, h.*, list_contains(c.chain, h.dst) AS seen FROM %s c JOIN hops h ON h.src = c.cur WHERE NOT c.done AND c.hop < {N})"""
CHAIN_END = f"""
SELECT url, cur AS final_url, len(chain) AS chain_length, flagged OR len(chain) >= {N} AS red_suspicious,
  CASE WHEN len(chain) >= {N} THEN greatest(risk, {d(0.6)}) ELSE risk END AS red_risk,
  CASE WHEN len(chain) >= {N} THEN list_append(reasons, 'Maximum redirect chain length exceeded') ELSE reasons END AS red_reasons
FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY hop DESC) AS rn FROM %s) WHERE rn = 1"""
block("url_walk", CHAIN % ("url_n", "url_walk"), "url_n", "hops")
block("url_chain", CHAIN_END % "url_walk", "url_walk")
block("link_walk", CHAIN % ("links_n", "link_walk"), "links_n", "hops")
block("link_chain", CHAIN_END % "link_walk", "link_walk")


def verdict(scored: str, chains: str, keep: str) -> str:
    none = "CAST([] AS VARCHAR[])"
    return f"""
SELECT {keep}, s.raw_url, s.url, s.registered_domain, coalesce(c.chain_length, 1) AS chain_length,
  s.dom_suspicious OR coalesce(c.red_suspicious, false) OR s.str_suspicious AS suspicious,
  greatest({d(0)}, CASE WHEN s.dom_suspicious THEN s.dom_risk ELSE {d(0)} END,
    CASE WHEN c.red_suspicious THEN c.red_risk ELSE {d(0)} END, CASE WHEN s.str_suspicious THEN s.str_risk ELSE {d(0)} END) AS risk,
  list_concat(list_concat(CASE WHEN s.dom_suspicious THEN s.dom_reasons ELSE {none} END,
    CASE WHEN c.red_suspicious THEN c.red_reasons ELSE {none} END),
    CASE WHEN s.str_suspicious THEN s.str_reasons ELSE {none} END) AS reasons
FROM {scored} s LEFT JOIN {chains} c ON c.url = s.url"""


block("verdicts", verdict("links_s", "link_chain", "s.mail_id, s.pos"), "links_s", "link_chain")
block("url_verdicts", verdict("url_s", "url_chain", "1 AS one"), "url_s", "url_chain")
_short = " OR ".join(f"contains(lower(raw_url), '{s}')" for s in rules.URL_SHORTENERS)
block("url_rollup", f"""
SELECT m.mail_id, count(v.raw_url) AS total_urls, count(*) FILTER (WHERE v.suspicious) AS suspicious_urls,
  count(DISTINCT v.registered_domain) AS unique_domains, count(*) FILTER (WHERE {_short}) AS shortener_count,
  count(*) FILTER (WHERE v.chain_length > 1) AS redirect_count, coalesce(max(v.risk), {d(0)}) AS url_risk
FROM mail m LEFT JOIN verdicts v ON v.mail_id = m.mail_id GROUP BY m.mail_id""", "mail", "verdicts")
