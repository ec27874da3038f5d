"""Sender analytics against snapshot tables.

Everything about a domain is worked out once per distinct domain
(:func:`domain_profile`) and brought back to the mails with one lookup join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailglass import rules
from mailglass.functions.edits import nearest_names
from mailglass.functions.headers import header_line, header_value, headers_of
from mailglass.functions.join import lookup_join
from mailglass.functions.text import compact, first_match, flag, weighted_mean

ADDRESS = r"^([a-zA-Z0-9._%+-]+)@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})$"
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
IPV6 = (r"^(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$|"
        r"^(?:(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4})?::(?:(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4})?$")


def address_user(address: Column) -> Column:
    return first_match(address, ADDRESS, 1)


def address_domain(address: Column) -> Column:
    return first_match(address, ADDRESS, 2)


def parse_address(df: DataFrame, column: str = "sender") -> DataFrame:
    """Add username and domain, both null for an address of the wrong form."""
    return df.withColumns({"username": address_user(F.col(column)), "domain": address_domain(F.col(column))})


def domain_age(domains: DataFrame, whois: DataFrame, as_of: Column) -> DataFrame:
    """Age bands of each domain; a failed or missing lookup gives 0.5 and a
    record without a date 0.0. ``lite_age_risk`` holds the light scorer's bands."""
    created = F.try_element_at("creation_dates", F.lit(1))
    df = domains.join(whois.select("domain", "creation_dates", "registrar", "ok"), "domain", "left")
    found = F.coalesce("ok", F.lit(False))
    days = F.when(found, F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(created)) / 86400))
    df = df.withColumn("domain_age_days", days)
    age = F.col("domain_age_days")
    return df.withColumns({
        "is_new_domain": F.coalesce(age < 30, F.lit(False)),
        "registration_date": F.when(age.isNotNull(), F.date_format(created, "yyyy-MM-dd")),
        "age_risk": F.when(~found, 0.5).when(age.isNull(), 0.0).when(age < 30, 0.9).when(age < 90, 0.6)
                     .when(age < 180, 0.3).otherwise(0.1),
        "lite_age_risk": F.when(~found, 0.1).when(age < 14, 0.3).when(age < 30, 0.15).otherwise(0.0),
    }).drop("creation_dates", "ok")


def spf_is_valid(mechanisms: Column) -> Column:
    """Known names only, valid addresses, exactly one 'all'."""
    bare = F.transform(mechanisms, lambda m: F.regexp_replace(m, "^[+~?-]", ""))
    name = lambda m: F.lower(F.substring_index(m, ":", 1))
    value = lambda m: F.substring_index(F.regexp_replace(m, "^[^:]*:?", ""), "/", 1)
    has_value = lambda m: F.contains(m, F.lit(":"))
    ok = F.forall(bare, lambda m: name(m).isin(rules.SPF_MECHANISMS)
                  & ((name(m) != "ip4") | ~has_value(m) | value(m).rlike(IPV4))
                  & ((name(m) != "ip6") | ~has_value(m) | value(m).rlike(IPV6) & (F.regexp_count(value(m), F.lit(":")) <= 7)))
    return ok & (F.size(F.filter(bare, lambda m: name(m) == "all")) == 1)


def spf(domains: DataFrame, dns_txt: DataFrame, compat: bool = False) -> DataFrame:
    """SPF record of each domain, its mechanisms, validity and risk.

    Quotes and the version token are removed before validation; ``compat``
    leaves them in, which makes every record invalid.
    """
    records = dns_txt.groupBy(F.col("name").alias("domain")).agg(
        F.min_by(F.when(F.contains("txt", F.lit("v=spf1")), F.col("txt")),
                 F.when(F.contains("txt", F.lit("v=spf1")), F.col("ord"))).alias("spf_record"),
        F.max("status").alias("_worst"), F.bool_or(F.col("status") == "NXDOMAIN").alias("_nx"),
        F.bool_or(F.col("status") == "ERROR").alias("_err"))
    df = domains.join(records, "domain", "left")
    text = F.col("spf_record") if compat else F.regexp_replace("spf_record", '"', "")
    tokens = F.filter(F.split(text, " "), lambda m: m != "")
    df = df.withColumn("spf_mechanisms", F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(0))))
    first_all = F.try_element_at(F.filter("spf_mechanisms", lambda m: m.isin("+all", "-all", "~all", "?all")), F.lit(1))
    df = df.withColumns({
        "has_spf": F.col("spf_record").isNotNull(),
        "spf_all": first_all,
        "spf_valid": F.lit(False) if compat else F.coalesce(spf_is_valid(F.col("spf_mechanisms")), F.lit(False)),
        "spf_includes": F.transform(F.filter("spf_mechanisms", lambda m: F.startswith(m, F.lit("include:"))),
                                    lambda m: F.substring(m, F.lit(9), F.length(m))),
    })
    by_all = (F.when(F.col("spf_all") == "-all", 0.2).when(F.col("spf_all") == "~all", 0.4)
              .when(F.col("spf_all") == "?all", 0.6).when(F.col("spf_all") == "+all", 0.8).otherwise(0.5))
    return df.withColumn("spf_risk", F.when(
        F.col("has_spf"), F.when(F.col("spf_valid"), by_all).otherwise(F.greatest(by_all, F.lit(0.7))))
        .when(F.col("_nx"), 1.0).when(F.col("_err"), 0.6).otherwise(0.8)).drop("_worst", "_nx", "_err")


def dmarc(domains: DataFrame, dns_txt: DataFrame) -> DataFrame:
    """DMARC policy of each domain; no answer counts as a failed lookup."""
    is_record = F.contains("txt", F.lit("v=DMARC1"))
    records = (dns_txt.filter(F.startswith("name", F.lit("_dmarc.")))
               .groupBy(F.substring(F.col("name"), F.lit(8), F.length("name")).alias("domain"))
               .agg(F.min_by(F.when(is_record, F.regexp_replace("txt", '"', "")), F.when(is_record, F.col("ord"))).alias("dmarc_record"),
                    F.bool_or(F.col("status") == "NOERROR").alias("_answered")))
    df = domains.join(records, "domain", "left")
    record = F.col("dmarc_record")
    df = df.withColumns({
        "has_dmarc": record.isNotNull(),
        "dmarc_policy": first_match(record, r"p=(\w+)"),
        "dmarc_subdomain_policy": first_match(record, r"sp=(\w+)"),
        "dmarc_pct": first_match(record, r"pct=(\d+)").try_cast("int"),
        "dmarc_rua": first_match(record, r"rua=mailto:([^;]+)"),
        "dmarc_ruf": first_match(record, r"ruf=mailto:([^;]+)"),
    })
    return df.withColumn("dmarc_risk", F.when(
        F.col("has_dmarc"), F.when(F.col("dmarc_policy") == "reject", 0.1).when(F.col("dmarc_policy") == "quarantine", 0.2).otherwise(0.3))
        .when(F.coalesce("_answered", F.lit(False)), 0.7).otherwise(0.5)).drop("_answered")


def reputation(domains: DataFrame, table: DataFrame) -> DataFrame:
    """Reputation of each domain: trusted first, else its first table row."""
    fields = ["reputation_score", "blacklisted", "blacklist_count", "sources"]
    first = table.groupBy("domain").agg(F.min_by(F.struct(*fields), "ord").alias("_row"))
    df = domains.join(first, "domain", "left")
    trusted = F.col("domain").isin(rules.SENDER_TRUSTED)
    row = F.when(~trusted, F.col("_row"))
    return df.withColumns({
        "reputation_score": F.when(trusted, 0.9).otherwise(F.coalesce(row["reputation_score"], F.lit(0.5))),
        "blacklisted": F.coalesce(row["blacklisted"], F.lit(False)),
        "blacklist_count": F.coalesce(row["blacklist_count"], F.lit(0)),
        "sources": F.coalesce(F.split(row["sources"], ","), F.array().cast("array<string>")),
        "reputation_risk": F.when(trusted, 0.1).otherwise(F.coalesce(F.lit(1.0) - row["reputation_score"], F.lit(0.5))),
    }).drop("_row")


def look_alike(domains: DataFrame, trusted: DataFrame | None = None) -> DataFrame:
    """Nearest trusted domain by edit distance; ties go to list order.

    The built-in list is fixed and short, so the comparison is an expression on each
    distinct domain and needs no join, and the distance is known however far it is.
    A table ``trusted`` (domain, ord) of any length is matched through
    :func:`nearest_names`: what is more than two edits away has no ``edit_distance``
    and a ``similarity`` of 0. Trusted domains themselves are skipped.
    """
    if trusted is None:
        known = F.col("domain").isin(rules.SENDER_TRUSTED)
        nearest = F.least(*[F.struct(F.levenshtein("domain", F.lit(t)).alias("distance"), F.lit(i).alias("ord"),
                                     F.lit(t).alias("name")) for i, t in enumerate(rules.SENDER_TRUSTED)])
        df = domains.withColumn("_near", F.when(~known, nearest))
    else:
        found = nearest_names(domains.select("domain").distinct(), trusted.select(F.col("domain").alias("name"), "ord"), "domain")
        found = found.filter(F.col("distance") > 0).select("domain", F.struct("distance", "ord", "name").alias("_near"))
        df = domains.join(found, "domain", "left")
    distance, name = F.col("_near.distance"), F.col("_near.name")
    close = F.coalesce(distance <= 2, F.lit(False))
    return df.withColumns({
        "typo_suspicious": close,
        "similar_to": F.when(close, name),
        "edit_distance": distance,
        "similarity": F.coalesce(F.lit(1.0) - distance / F.greatest(F.length("domain"), F.length(name)), F.lit(0.0)),
        "typo_risk": F.when(close & (distance == 1), 0.9).when(close, 0.7).otherwise(0.0),
    }).drop("_near")


def domain_profile(domains: DataFrame, whois: DataFrame, dns_txt: DataFrame, reputation_table: DataFrame,
                   as_of: Column, compat: bool = False, trusted: DataFrame | None = None) -> DataFrame:
    """All domain-level checks for a frame of distinct domains."""
    df = domain_age(domains, whois, as_of)
    df = spf(df, dns_txt, compat)
    df = dmarc(df, dns_txt)
    df = reputation(df, reputation_table)
    return look_alike(df, trusted)


def dkim(mail: DataFrame, results: DataFrame) -> DataFrame:
    """Signature facts of each mail joined to the recorded check outcome."""
    signature = header_line(headers_of(F.col("raw")), "DKIM-Signature")
    df = mail.withColumn("_sig", signature).join(results.select("mail_id", "verified", "error"), "mail_id", "left")
    valid = F.col("_sig").isNotNull() & F.coalesce("verified", F.lit(False)) & ~F.coalesce("error", F.lit(False))
    return df.withColumns({
        "has_dkim": F.col("_sig").isNotNull(),
        "dkim_valid": valid,
        "dkim_domain": first_match(F.col("_sig"), "d=([^;]+)"),
        "dkim_selector": first_match(F.col("_sig"), "s=([^;]+)"),
        "dkim_risk": F.when(F.col("_sig").isNull(), 0.5).when(F.coalesce("error", F.col("verified").isNull()), 0.6)
                      .when(F.col("verified"), 0.1).otherwise(0.8),
    }).drop("_sig", "verified", "error")


def alignment(mail: DataFrame, sender: str = "sender") -> DataFrame:
    """Header domains that differ from the sender's domain."""
    headers = headers_of(F.col("raw"))
    own = address_domain(F.col(sender))
    from_domain = first_match(header_value(headers, "From"), r"@([^>\s]+)")
    return_domain = address_domain(first_match(header_line(headers, "Return-Path"), "<([^>]+)>"))
    reply_domain = address_domain(first_match(header_value(headers, "Reply-To"), r"([^<\s]+@[^>\s]+)"))
    df = mail.withColumn("misaligned_headers", F.when(own.isNotNull(), compact(
        flag(other != own, F.concat(F.lit(f"{name}: "), other))
        for name, other in (("From", from_domain), ("Return-Path", return_domain), ("Reply-To", reply_domain))))
        .otherwise(F.array().cast("array<string>")))
    return df.withColumn("alignment_risk", F.when(F.size("misaligned_headers") > 0, 0.8).otherwise(0.0))


def score_senders(mail: DataFrame, whois: DataFrame, dns_txt: DataFrame, reputation_table: DataFrame,
                  dkim_results: DataFrame, as_of: Column, compat: bool = False, trusted: DataFrame | None = None) -> DataFrame:
    """Weighted sender risk of each mail with its component risks."""
    df = mail.withColumns({"sender_user": address_user(F.col("sender")), "sender_domain": address_domain(F.col("sender"))})
    domains = df.select(F.col("sender_domain").alias("domain")).filter("domain IS NOT NULL").distinct()
    profile = domain_profile(domains, whois, dns_txt, reputation_table, as_of, compat, trusted).select(
        F.col("domain").alias("sender_domain"), "age_risk", "reputation_risk", "typo_risk", "spf_risk", "dmarc_risk",
        "is_new_domain", "similar_to", "domain_age_days")
    df = alignment(dkim(df, dkim_results))
    df = lookup_join(df, profile, ["sender_domain"], spread_by="mail_id")
    score = weighted_mean({
        "domain_age": F.col("age_risk"), "domain_reputation": F.col("reputation_risk"), "typosquatting": F.col("typo_risk"),
        "spf": F.col("spf_risk"), "dmarc": F.col("dmarc_risk"), "dkim": F.col("dkim_risk"),
        "domain_alignment": F.col("alignment_risk")}, rules.SENDER_WEIGHTS)
    return df.withColumn("sender_risk", F.when(F.col("sender_domain").isNull(), 0.8).otherwise(score))


def lite_sender(mail: DataFrame, whois: DataFrame, mx: DataFrame, as_of: Column,
                trusted: list[str] | None = None) -> DataFrame:
    """Additive light sender score: brand names, domain age, missing MX."""
    trusted = rules.SENDER_TRUSTED if trusted is None else trusted
    df = mail.withColumn("lite_domain", F.when(F.contains("sender", F.lit("@")), F.lower(F.split_part("sender", F.lit("@"), F.lit(2)))))
    domains = df.select(F.col("lite_domain").alias("domain")).filter("domain IS NOT NULL").distinct()
    facts = domain_age(domains, whois, as_of).select("domain", "lite_age_risk")
    no_mx = domains.join(mx, "domain", "left_anti").withColumn("no_mx", F.lit(True))
    facts = facts.join(no_mx, "domain", "left").withColumnRenamed("domain", "lite_domain")
    df = lookup_join(df, facts, ["lite_domain"], spread_by="mail_id")
    exempt = F.lit(False)
    for name in trusted:
        exempt = exempt | F.endswith("lite_domain", F.lit(name))
    total, factors = F.lit(0.0), []
    for brand in rules.LITE_BRANDS:
        hit = F.contains("lite_domain", F.lit(brand)) & ~F.endswith("lite_domain", F.lit(f".{brand}.com")) & ~exempt
        total = total + F.when(hit, 0.4).otherwise(0.0)
        factors.append(flag(hit, f"Possible typosquatting of {brand}"))
    age, missing = F.col("lite_age_risk"), F.coalesce("no_mx", F.lit(False))
    total = total + age + F.when(missing, 0.3).otherwise(0.0)
    factors += [flag(age == 0.3, "Domain is less than 14 days old"), flag(age == 0.15, "Domain is relatively new (14-30 days old)"),
                flag(age == 0.1, "Could not verify domain age"), flag(missing, "No valid MX records")]
    bad = F.col("lite_domain").isNull()
    return df.withColumns({
        "lite_sender_risk": F.when(F.col("sender").isNull(), 0.5).when(bad, 0.8).otherwise(total),
        "lite_sender_factors": F.when(F.col("sender").isNull(), F.array(F.lit("No sender information")))
                                .when(bad, F.array(F.lit("Invalid sender email format"))).otherwise(compact(factors)),
    }).drop("lite_age_risk", "no_mx")


def sender_facts(df: DataFrame, sender: str = "sender", subject: str = "subject") -> DataFrame:
    """Known domain, business domain, sender category and mail type."""
    domain = F.lower(F.split_part(F.col(sender), F.lit("@"), F.lit(2)))
    category = F.coalesce(*[F.when(domain == k, v) for k, v in rules.SENDER_CATEGORY_EXACT],
                          *[F.when(F.contains(domain, F.lit(k)), v) for k, v in rules.SENDER_CATEGORY_PART], F.lit("unknown"))
    text = F.lower(F.col(subject))

    def any_of(words):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(text, F.lit(word))
        return hit

    kind = F.coalesce(*[F.when(any_of(words), name) for name, words in rules.MAIL_TYPES], F.lit("general"))
    return df.withColumns({
        "is_known_sender": domain.isin(rules.KNOWN_SENDER_DOMAINS),
        "is_business_domain": ~domain.isin(rules.FREE_MAIL_DOMAINS),
        "sender_category": category,
        "email_type": F.when(F.coalesce(text, F.lit("")) == "", "unknown").otherwise(kind),
    })
