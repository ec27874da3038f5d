"""Link analytics: one row per mail and link, rolled up to one row per mail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailglass import rules
from mailglass.functions import url as U
from mailglass.functions.join import fits_broadcast, lookup_join
from mailglass.functions.text import compact, flag
from mailglass.session import materialize


def mail_links(mail: DataFrame, text: str = "raw", keep_empty: bool = False) -> DataFrame:
    """(mail_id, pos, raw_url). ``keep_empty`` keeps mails without links as one
    row with a null link, so a later rollup needs no join back to the mails."""
    explode = F.posexplode_outer if keep_empty else F.posexplode
    return mail.select("mail_id", explode(U.extract_urls(F.col(text))).alias("pos", "raw_url"))


def simple_links(mail: DataFrame, text: str = "raw", host_only: bool = False) -> DataFrame:
    """Every occurrence in the simple dialects, repeats included."""
    return mail.select("mail_id", F.posexplode(U.scan_urls(F.col(text), host_only)).alias("pos", "link"))


def score_structure_and_domain(links: DataFrame, compat: bool = False, suffixes: U.Suffixes = U.BUILT_IN) -> DataFrame:
    """Normalise each link and apply the domain and structure rules (no shuffle)."""
    df = U.with_parts(U.with_normalized(links, "raw_url", "url"), suffixes=suffixes)
    df = U.domain_rules(df, compat)
    return U.structure_rules(df, compat=compat)


def prepare_hops(edges: DataFrame, compat: bool = False, suffixes: U.Suffixes = U.BUILT_IN) -> DataFrame:
    """One outgoing hop per normalised source, with its pair and target scores."""
    df = U.with_normalized(edges.select("src", "dst", "kind", "ssl_ok"), "src", "src")
    df = U.with_normalized(df, "dst", "dst")
    df = df.groupBy("src").agg(F.min(F.struct("dst", "kind", "ssl_ok")).alias("hop")).select("src", "hop.*")
    df = score_hop_pairs(df, compat, suffixes)
    target = U.domain_rules(U.with_parts(df, "dst", suffixes), compat)
    # read once per hop by redirect_chains, so it is scored and written once
    return materialize(target.select(
        "src", "dst", "kind", "ssl_ok", "pair_suspicious", F.col("dom_suspicious").alias("dst_suspicious"),
        F.col("dom_risk").alias("dst_risk"), F.col("dom_reasons").alias("dst_reasons")))


def score_hop_pairs(edges: DataFrame, compat: bool = False, suffixes: U.Suffixes = U.BUILT_IN) -> DataFrame:
    """Add pair_suspicious to rows with src and dst."""
    wanted = ["scheme", "port", "registered_domain"]
    df = edges
    for side in ("src", "dst"):
        keep = df.columns
        df = U.with_parts(df, side, suffixes)
        df = df.select(*keep, *[F.col(c).alias(f"_{side}_{c}") for c in wanted])
    return df.withColumn("pair_suspicious", U.pair_is_suspicious("_src", "_dst", "dst", compat)) \
        .select(*edges.columns, "pair_suspicious")


def redirect_chains(starts: DataFrame, hops: DataFrame, limit: int = rules.MAX_REDIRECTS) -> DataFrame:
    """Follow each distinct ``url`` for at most ``limit`` requests.

    ``hops`` comes from :func:`prepare_hops`. Links without an outgoing hop are
    left out (their chain is the link itself). The hop joins go through
    ``lookup_join``, so a landing page that a third of all chains reach is
    spread over many tasks.
    """
    front = starts.select("url").join(hops.select(F.col("src").alias("url")), "url", "left_semi")
    empty = F.array().cast("array<string>")
    df = front.select("url", F.col("url").alias("cur"), F.array("url").alias("chain"), F.lit(0.0).alias("risk"),
                      F.lit(False).alias("flagged"), empty.alias("reasons"), F.lit(False).alias("done"))
    step = hops.withColumnRenamed("src", "cur")
    small = fits_broadcast(step)
    for _ in range(limit):
        if not small:  # the lookup counts its keys, so the walk so far is written, not redone
            df = materialize(df)
        df = _follow(lookup_join(df, step, ["cur"], spread_by="url", true_size=True))
    too_long = F.size("chain") >= limit
    return df.select(
        "url", F.col("cur").alias("final_url"), F.size("chain").alias("chain_length"),
        (F.col("flagged") | too_long).alias("red_suspicious"),
        F.when(too_long, F.greatest(F.col("risk"), F.lit(0.6))).otherwise(F.col("risk")).alias("red_risk"),
        F.when(too_long, F.array_append("reasons", F.lit("Maximum redirect chain length exceeded")))
         .otherwise(F.col("reasons")).alias("red_reasons"))


def _follow(df: DataFrame) -> DataFrame:
    active = F.col("dst").isNotNull() & ~F.col("done")
    fetched = active & F.col("ssl_ok")
    http, meta = fetched & (F.col("kind") == "http"), fetched & (F.col("kind") == "meta")
    seen = F.array_contains("chain", F.coalesce("dst", F.lit("")))
    moved = fetched & ~seen
    broken, loop = active & ~F.col("ssl_ok"), http & seen
    odd = fetched & F.col("pair_suspicious")
    bad_target = http & moved & F.col("dst_suspicious")
    arrow = F.concat(F.col("cur"), F.lit(" -> "), F.col("dst"))
    found = F.concat(
        compact([flag(odd & http, F.concat(F.lit("Suspicious redirect: "), arrow)),
                 flag(odd & meta, F.concat(F.lit("Suspicious meta refresh: "), arrow)),
                 flag(loop, "Redirect loop detected"),
                 flag(broken, F.concat(F.lit("SSL certificate validation failed: "), F.col("cur")))]),
        F.when(bad_target, F.col("dst_reasons")).otherwise(F.array().cast("array<string>")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return df.select(
        "url",
        F.when(yes(moved), F.col("dst")).otherwise(F.col("cur")).alias("cur"),
        F.when(yes(moved), F.array_append("chain", F.col("dst"))).otherwise(F.col("chain")).alias("chain"),
        F.greatest("risk", F.when(broken, 0.9), F.when(odd & http, 0.7), F.when(odd & meta, 0.8),
                   F.when(loop, 0.8), F.when(bad_target, F.col("dst_risk"))).alias("risk"),
        (F.col("flagged") | yes(broken) | yes(odd) | yes(loop) | yes(bad_target)).alias("flagged"),
        F.concat("reasons", found).alias("reasons"),
        (~yes(moved)).alias("done"))


def link_verdicts(links: DataFrame, hops: DataFrame | None = None, compat: bool = False, suffixes: U.Suffixes = U.BUILT_IN) -> DataFrame:
    """Per-link verdict: max risk and joined reasons of the suspicious parts.

    ``links`` has (mail_id, pos, raw_url); rows with a null link pass through
    with zero risk. ``suffixes`` comes from ``functions.url.suffix_rules``.
    """
    df = score_structure_and_domain(links, compat, suffixes)
    if hops is None:
        df = df.withColumns({"red_suspicious": F.lit(False), "red_risk": F.lit(0.0), "chain_length": F.lit(1),
                             "red_reasons": F.array().cast("array<string>")})
    else:
        chains = redirect_chains(df.select("url").filter(F.col("url").isNotNull()).distinct(), hops)
        df = lookup_join(df, chains.drop("final_url"), ["url"], spread_by="mail_id")
    none = F.array().cast("array<string>")

    def part(prefix, value, default):
        return F.when(F.coalesce(F.col(f"{prefix}_suspicious"), F.lit(False)), F.col(f"{prefix}_{value}")).otherwise(default)

    return df.select(
        "mail_id", "pos", "raw_url", "url", "registered_domain",
        F.coalesce("chain_length", F.lit(1)).alias("chain_length"),
        (F.coalesce("dom_suspicious", F.lit(False)) | F.coalesce("red_suspicious", F.lit(False))
         | F.coalesce("str_suspicious", F.lit(False))).alias("suspicious"),
        F.greatest(*[part(p, "risk", F.lit(0.0)) for p in ("dom", "red", "str")]).alias("risk"),
        F.concat(*[part(p, "reasons", none) for p in ("dom", "red", "str")]).alias("reasons"))


def roll_up_links(verdicts: DataFrame) -> DataFrame:
    """One row per mail: counts, distinct registered domains, flags, max risk.

    Feed it verdicts made with ``keep_empty=True`` to keep mails without links.
    """
    present = F.col("raw_url").isNotNull()
    shortened = F.lit(False)
    for name in rules.URL_SHORTENERS:  # substring test, wider than the host rule
        shortened = shortened | F.contains(F.lower("raw_url"), F.lit(name))
    df = verdicts.groupBy("mail_id").agg(
        F.count("raw_url").alias("total_urls"),
        F.count_if(present & F.col("suspicious")).alias("suspicious_urls"),
        F.size(F.collect_set(F.when(present, F.col("registered_domain")))).cast("long").alias("unique_domains"),
        F.count_if(shortened).alias("shortener_count"),
        F.count_if(present & (F.col("chain_length") > 1)).alias("redirect_count"),
        F.coalesce(F.max(F.when(present, F.col("risk"))), F.lit(0.0)).alias("url_risk"),
        F.sort_array(F.collect_list(F.when(F.col("suspicious"), F.struct("pos", "raw_url", "risk", "reasons")))).alias("suspicious_links"))
    share = F.when(F.col("total_urls") > 0, F.col("suspicious_urls") / F.col("total_urls") * 100).otherwise(0.0)
    many_domains, many_short, many_hops = (F.col("unique_domains") > 2, F.col("shortener_count") > 1,
                                           F.col("redirect_count") > 2)
    return df.withColumns({
        "suspicious_share": share,
        "url_suspicious": (F.col("suspicious_urls") > 0) | many_domains | many_short | many_hops,
        "url_reasons": compact([
            flag(F.col("suspicious_urls") > 0,
                 F.concat(F.format_number(share, 1), F.lit("% of URLs ("), F.col("suspicious_urls").cast("string"),
                          F.lit(") show suspicious characteristics"))),
            flag(many_domains, F.concat(F.lit("Multiple target domains detected ("), F.col("unique_domains").cast("string"), F.lit(")"))),
            flag(many_short, F.concat(F.lit("Multiple URL shorteners detected ("), F.col("shortener_count").cast("string"), F.lit(")"))),
            flag(many_hops, F.concat(F.lit("Multiple redirect chains detected ("), F.col("redirect_count").cast("string"), F.lit(")")))])})


def repeated_reasons(verdicts: DataFrame) -> DataFrame:
    """Reasons that occur more than once among a mail's suspicious links."""
    return (verdicts.filter("suspicious").select("mail_id", F.explode("reasons").alias("reason"))
            .groupBy("mail_id", "reason").agg(F.count("*").alias("n")).filter("n > 1"))


def lite_links(mail: DataFrame, text: str = "raw") -> DataFrame:
    """Additive light score of each link occurrence."""
    df = mail.select("mail_id", F.posexplode_outer(U.scan_urls(F.col(text))).alias("pos", "link"))
    host = F.lower(U.netloc(F.col("link")))
    df = df.withColumn("host", host)
    points, factors = F.lit(0.0), []
    for brand in rules.LITE_BRANDS:
        hit = F.contains("host", F.lit(brand)) & ~F.endswith("host", F.lit(f".{brand}.com"))
        points = points + F.when(hit, 0.4).otherwise(0.0)
        factors.append(flag(hit, f"Possible typosquatting of {brand}"))
    cheap = F.lit(False)
    for tld in rules.LITE_TLDS:
        cheap = cheap | F.endswith("host", F.lit(tld))
    ip = F.col("host").rlike(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}")
    points = points + F.when(cheap, 0.3).otherwise(0.0) + F.when(ip, 0.4).otherwise(0.0)
    factors += [flag(cheap, "Suspicious top-level domain"), flag(ip, "IP address used in URL")]
    return df.withColumns({"link_risk": points, "factors": compact(factors)})


def lite_mail_score(mail: DataFrame, text: str = "raw") -> DataFrame:
    """Per mail: link count, risky link count, highest light link score."""
    return lite_links(mail, text).groupBy("mail_id").agg(
        F.count("link").alias("urls_found"),
        F.count_if(F.col("link_risk") > 0).alias("risky_urls"),
        F.max(F.when(F.col("link").isNotNull(), F.col("link_risk")).otherwise(0.0)).alias("lite_url_risk"),
        F.sort_array(F.collect_list(F.when(F.col("link_risk") > 0, F.struct(F.col("pos"), F.col("link"), F.col("link_risk"))))).alias("risky_links"))


def mean_risk_rollup(verdicts: DataFrame) -> DataFrame:
    """Other rollup: mean risk of the suspicious links, distinct reasons."""
    df = verdicts.groupBy("mail_id").agg(
        F.coalesce(F.avg(F.when(F.col("suspicious"), F.col("risk"))), F.lit(0.0)).alias("mean_risk"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("suspicious"), F.col("reasons")))))).alias("reasons"))
    return df.withColumn("suspicious", F.col("mean_risk") > 0.5)


def link_elements(mail: DataFrame, text: str = "raw") -> DataFrame:
    """Element rows of the simple link scorer."""
    link = F.col("link")
    keyword = F.lit(False)
    for word in rules.ELEMENT_URL_KEYWORDS:
        keyword = keyword | F.contains(link, F.lit(word))
    score = (F.when(link.rlike(r"^https?://\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"), 0.95)
             .when(keyword, 0.85).otherwise(0.7))
    return simple_links(mail, text, host_only=True).select(
        "mail_id", "pos", F.lit("url").alias("type"),
        F.concat(F.lit("Suspicious URL: "), link).alias("description"), score.alias("risk_score"))


def link_context(df: DataFrame, text: str = "raw", link: str = "raw_url", reach: int = 50) -> DataFrame:
    """Text around the first occurrence of a link, the link in brackets."""
    at = F.instr(F.col(text), F.col(link)) - 1
    start = F.greatest(F.lit(0), at - reach)
    size = F.length(link)
    window = F.substring(F.col(text), start + 1, (at - start) + size + reach)
    window = F.regexp_replace(window, r"^\s+|\s+$", "")
    lead = at - start
    marked = F.concat(F.left(window, lead), F.lit("["), F.substring(window, lead + 1, size), F.lit("]"),
                      F.substring(window, lead + size + 1, F.length(window)))
    return df.withColumn("context", F.when(at < 0, F.lit("")).when(lead > 0, marked).otherwise(window))
