"""URL expressions: split, normalise, rule scores.

All of them are plain column expressions, so link rules run as one narrow
projection over the exploded link rows without any shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailglass import rules
from mailglass.functions.text import compact, flag

HREF = r"href=[\"'](https?://[^\"'>]+)[\"']"
BARE = r"(https?://[^\s<>\"']+)"
WITH_PATH = r"https?://(?:[-\p{L}\p{N}_.]|(?:%[\da-fA-F]{2}))+[^\s]*"
HOST_ONLY = r"https?://(?:[-\p{L}\p{N}_.]|(?:%[\da-fA-F]{2}))+"


def extract_urls(text: Column) -> Column:
    """Distinct links of a mail: href values first, then bare links."""
    bare_text = F.regexp_replace(text, r"(href=[\"'])https?://", "$1")
    return F.array_distinct(
        F.concat(F.regexp_extract_all(text, F.lit(HREF), F.lit(1)),
                 F.regexp_extract_all(bare_text, F.lit(BARE), F.lit(1)))
    )


def scan_urls(text: Column, host_only: bool = False) -> Column:
    """Every link occurrence in the simple dialects (with path or host only)."""
    return F.regexp_extract_all(text, F.lit(HOST_ONLY if host_only else WITH_PATH), F.lit(0))


def unquote(text: Column) -> Column:
    """Percent-decode; '+' and malformed escapes stay as they are."""
    safe = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")),
                            r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), text)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host_of(authority: Column) -> Column:
    return F.lower(F.regexp_extract(authority, r"^(?:[^@]*@)?([^:]*)", 1))


def port_of(authority: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(authority, r":([0-9]{1,5})$", 1), F.lit("")),
                           F.lit("99999")).cast("int")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def query_pairs(query_text: Column) -> Column:
    """Decoded (key, value) structs; blank values are dropped."""
    kept = F.filter(F.split(query_text, "&"), lambda p: p.rlike("^[^=]*=(?s:.+)$"))

    def decoded(piece: Column) -> Column:
        return unquote(F.replace(piece, F.lit("+"), F.lit(" ")))

    return F.transform(kept, lambda p: F.struct(
        decoded(F.regexp_extract(p, "^([^=]*)=", 1)).alias("key"),
        decoded(F.regexp_extract(p, "^[^=]*=((?s:.+))$", 1)).alias("value")))


def with_normalized(df: DataFrame, column: str, alias: str) -> DataFrame:
    """Add the normalised form of a link column: scheme added, host and path
    lowered, default port and fragment dropped, query keys sorted, percent
    escapes decoded. Built in steps so that each piece is computed once.
    """
    keep = df.columns
    raw = F.col(column)
    df = df.withColumn("_full", F.when(F.startswith(raw, F.lit("http://")) | F.startswith(raw, F.lit("https://")), raw)
                       .otherwise(F.concat(F.lit("http://"), raw)))
    df = df.withColumns({"_scheme": scheme(F.col("_full")), "_authority": F.lower(netloc(F.col("_full"))),
                         "_pairs": query_pairs(query(F.col("_full")))})
    default_port = ((F.col("_scheme") == "http") & F.col("_authority").rlike("^[^:]*:80$")
                    | (F.col("_scheme") == "https") & F.col("_authority").rlike("^[^:]*:443$"))
    df = df.withColumns({
        "_host": F.when(default_port, F.substring_index("_authority", ":", 1)).otherwise(F.col("_authority")),
        "_keys": F.array_sort(F.array_distinct(F.col("_pairs")["key"]))})
    merged = F.array_join(F.transform("_keys", lambda k: F.concat(
        k, F.lit("="), F.array_join(F.array_sort(F.transform(
            F.filter("_pairs", lambda p: p["key"] == k), lambda p: p["value"])), ","))), "&")
    df = df.withColumn("_joined", F.concat(
        F.col("_scheme"), F.lit("://"), F.col("_host"), F.lower(path(F.col("_full"))),
        F.when(F.size("_keys") > 0, F.concat(F.lit("?"), merged)).otherwise("")))
    return df.select(*[c for c in keep if c != alias], unquote(F.col("_joined")).alias(alias))


class Suffixes(NamedTuple):
    """Public-suffix rules by kind, without their marks."""

    plain: tuple[str, ...]
    wildcard: tuple[str, ...] = ()
    exception: tuple[str, ...] = ()


# This engine's own short table, used where the caller passes none.
BUILT_IN = Suffixes(tuple([
    "com", "net", "org", "edu", "gov", "info", "biz", "io", "co", "tv", "me",
    "ly", "gl", "so", "gd", "mp", "im", "cc", "eu", "uk", "de", "fr", "es",
    "it", "nl", "ie", "us", "ca", "au", "jp", "cn", "ru", "in", "br",
    "tk", "ga", "cf", "ml", "gq", "xyz", "top", "club", "news", "app", "dev",
    "online", "site", "shop", "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au",
    "co.jp", "com.br", "co.in", "co.nz",
]))
MAX_SUFFIX_RULES = 100_000


def suffix_rules(table: DataFrame, column: str = "suffix") -> Suffixes:
    """Rules of a suffix table in the public list's notation: ``co.uk``, ``*.ck``, ``!www.ck``.

    Such a list is a setting of about ten thousand rows whatever the mails are,
    and it becomes a hash set inside the plan. A table that is larger than
    ``MAX_SUFFIX_RULES`` is no suffix list and an error. Nulls and blanks are skipped.
    """
    rule = F.lower(F.trim(F.col(column)))
    rows = table.select(rule.alias("rule")).filter("rule <> ''").distinct().limit(MAX_SUFFIX_RULES + 1).collect()
    if len(rows) > MAX_SUFFIX_RULES:
        raise ValueError(f"more than {MAX_SUFFIX_RULES} rules: not a suffix list")
    rules_ = sorted(r.rule for r in rows)
    return Suffixes(tuple(r for r in rules_ if r[0] not in "*!"), tuple(r[2:] for r in rules_ if r.startswith("*.")),
                    tuple(r[1:] for r in rules_ if r[0] == "!"))


def suffix_of(host: str, suffixes: Suffixes = BUILT_IN) -> Column:
    """Public suffix of a host column: what an exception rule leaves, else the
    longest plain or wildcard rule, else the last of several labels ('' for a
    single label that no rule names). Rules may have any number of labels.
    """
    def last(n: int) -> Column:
        return F.substring_index(host, ".", -n)

    def listed(n: int, names: tuple[str, ...]) -> Column | None:
        own = [r.replace("\\", "\\\\").replace("'", "\\'") for r in names if r.count(".") == n - 1]
        return F.expr(f"substring_index({host}, '.', -{n}) IN ({', '.join(f'{chr(39)}{r}{chr(39)}' for r in own)})") if own else None

    longest = max((r.count(".") + 2 for kind in suffixes for r in kind), default=1)
    excepted, found = [], []
    for n in range(longest, 0, -1):
        if (hit := listed(n, suffixes.exception)) is not None:
            excepted.append(F.when(hit, last(n - 1)))
        if (hit := listed(n, suffixes.plain)) is not None:
            found.append(F.when(hit, last(n)))
        if n > 1 and (hit := listed(n - 1, suffixes.wildcard)) is not None:
            found.append(F.when(hit & (last(n) != last(n - 1)), last(n)))
    return F.coalesce(*excepted, *found, F.when(F.contains(F.col(host), F.lit(".")), last(1)), F.lit(""))


IP_HOST = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"


def with_parts(df: DataFrame, column: str = "url", suffixes: Suffixes = BUILT_IN) -> DataFrame:
    """Add scheme, netloc, host, port, path, query and the host split."""
    url = F.col(column)
    df = df.withColumns({"scheme": scheme(url), "netloc": netloc(url), "path": path(url), "query": query(url)})
    df = df.withColumns({"host": host_of(F.col("netloc")), "port": port_of(F.col("netloc"))})
    df = df.withColumn("suffix", F.when(F.col("host").rlike(IP_HOST), F.lit("")).otherwise(suffix_of("host", suffixes)))
    host, suffix = F.col("host"), F.col("suffix")
    stem = F.when(suffix == "", host).when(host == suffix, F.lit("")).otherwise(
        F.left(host, F.length(host) - F.length(suffix) - 1))
    df = df.withColumn("domain", F.when(host.rlike(IP_HOST), host).otherwise(F.substring_index(stem, ".", -1)))
    domain = F.col("domain")
    used = F.length(domain) + F.when(suffix == "", 0).otherwise(F.length(suffix) + 1)
    df = df.withColumn("subdomain", F.when(F.length(host) > used,
                                           F.left(host, F.length(host) - used - 1)).otherwise(F.lit("")))
    return df.withColumn("registered_domain", F.when((domain != "") & (suffix != ""),
                                                     F.concat(domain, F.lit("."), suffix)).otherwise(F.lit("")))


def domain_rules(df: DataFrame, compat: bool = False) -> DataFrame:
    """Add dom_suspicious, dom_reasons, dom_risk to rows carrying URL parts.

    The look-alike rule compares registered names; ``compat`` compares the label
    without its suffix, as the original scorer did.
    """
    netloc_, domain, suffix = F.col("netloc"), F.col("domain"), F.col("suffix")
    name = domain if compat else F.col("registered_domain")
    look_alike = F.coalesce(*[
        F.when((name != "") & (name != t) & (F.levenshtein(name, F.lit(t), 2) >= 0),
               F.lit(f"Possible typosquatting of {t}"))
        for t in rules.URL_TRUSTED])
    subdomains = F.when(F.col("subdomain") == "", 0).otherwise(F.size(F.split(F.col("subdomain"), r"\.")))
    checks = [
        (netloc_.isin(rules.URL_SHORTENERS), F.lit("URL shortener detected"), 0.6),
        (suffix.isin(rules.SUSPICIOUS_TLDS), F.concat(F.lit("Suspicious TLD: ."), suffix), 0.7),
        (netloc_.rlike(IP_HOST), F.lit("IP address used as domain"), 0.9),
        (look_alike.isNotNull(), look_alike, 0.8),
        (subdomains > 3, F.lit("Excessive number of subdomains"), 0.6),
        (F.col("port").isNotNull() & (F.col("port") != 0) & ~F.col("port").isin(80, 443),
         F.concat(F.lit("Unusual port: "), F.col("port").cast("string")), 0.7),
        *[(F.contains(F.lower(domain), F.lit(k)), F.lit(f"Suspicious keyword in domain: {k}"), 0.6)
          for k in rules.DOMAIN_KEYWORDS],
        (F.regexp_count(domain, F.lit("-")) > 2, F.lit("Excessive hyphens in domain"), 0.5),
    ]
    df = df.withColumns({
        "_hits": compact(flag(c, F.struct(r.alias("reason"), F.lit(float(s)).alias("risk"))) for c, r, s in checks),
        "_trusted": F.concat(domain, F.lit("."), suffix).isin(rules.URL_TRUSTED),
    })
    return df.withColumns({
        "dom_suspicious": ~F.col("_trusted") & (F.size("_hits") > 0),
        "dom_reasons": F.when(F.col("_trusted"), F.array(F.lit("Trusted domain")))
                        .otherwise(F.col("_hits")["reason"]),
        "dom_risk": F.when(F.col("_trusted"), F.lit(0.1))
                     .otherwise(F.coalesce(F.array_max(F.col("_hits")["risk"]), F.lit(0.0))),
    }).drop("_hits", "_trusted")


def structure_rules(df: DataFrame, raw: str = "raw_url", compat: bool = False) -> DataFrame:
    """Add str_suspicious, str_reasons, str_risk. Escapes and letter case are
    judged on the address as written, everything else on the normalised one."""
    url = F.col("url") if compat else F.col(raw)
    escapes = F.regexp_count(url, F.lit("%"))
    labels = F.size(F.split(F.col("netloc"), r"\.")) - 2
    checks = [
        (escapes > 3, F.concat(F.lit("Excessive URL encoding ("), escapes.cast("string"), F.lit(" instances)")), 0.6),
        *[(F.col("path").rlike(p), F.lit(f"Suspicious path pattern: {n}"), 0.7) for n, p in rules.PATH_PATTERNS],
    ]
    tail = [
        (netloc(url).rlike("[A-Z]"), F.lit("Mixed case in domain"), 0.5),
        (labels > 3, F.concat(F.lit("Excessive subdomains ("), labels.cast("string"), F.lit(")")), 0.6),
    ]

    def hits(items):
        return compact(flag(c, F.struct(r.alias("reason"), F.lit(float(s)).alias("risk"))) for c, r, s in items)

    df = df.withColumn("_pairs", query_pairs(F.col("query")))
    keys = F.array_distinct(F.col("_pairs")["key"])
    named = F.transform(
        F.filter(keys, lambda k: F.lower(k).isin(rules.REDIRECT_PARAMS)),
        lambda k: F.struct(F.concat(F.lit("Suspicious parameter: "), k).alias("reason"), F.lit(0.6).alias("risk")))
    linked = F.transform(
        F.filter(F.col("_pairs"), lambda p: F.contains(F.lower(unquote(p["value"])), F.lit("http"))),
        lambda p: F.struct(F.lit("URL found in parameter value").alias("reason"), F.lit(0.8).alias("risk")))
    df = df.withColumn("_hits", F.concat(hits(checks), named, linked, hits(tail)))
    return df.withColumns({
        "str_suspicious": F.size("_hits") > 0,
        "str_reasons": F.col("_hits")["reason"],
        "str_risk": F.coalesce(F.array_max(F.col("_hits")["risk"]), F.lit(0.0)),
    }).drop("_hits", "_pairs")


def pair_is_suspicious(src: str, dst: str, dst_url: str, compat: bool = False) -> Column:
    """Whether a hop between two prefixed part sets looks wrong."""
    s, d = (lambda c: F.col(f"{src}_{c}")), (lambda c: F.col(f"{dst}_{c}"))

    def effective_port(side):
        by_scheme = F.when(side("scheme") == "http", 80).otherwise(443)
        if compat:
            return F.when(side("scheme") == "http", F.coalesce(F.nullif(side("port"), F.lit(0)), F.lit(80))).otherwise(443)
        return F.coalesce(side("port"), by_scheme)

    downgrade = (s("scheme") == "https") & (d("scheme") == "http")
    port_change = effective_port(s) != effective_port(d)
    if not compat:
        upgrade = (s("scheme") == "http") & (d("scheme") == "https") & s("port").isNull() & d("port").isNull()
        port_change = port_change & ~upgrade
    foreign = (s("registered_domain") != d("registered_domain")) & ~d("registered_domain").isin(rules.URL_TRUSTED)
    shaped = F.lit(False)
    for pattern in rules.REDIRECT_TARGET_PATTERNS:
        shaped = shaped | F.col(dst_url).rlike("(?i)" + pattern)
    return downgrade | port_change | foreign | shaped
