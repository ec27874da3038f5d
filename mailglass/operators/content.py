"""Content analytics: lexicon scores, indicator bank, hand features, image text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailglass import rules
from mailglass.functions import url as U
from mailglass.functions.bank import PatternBank, needed
from mailglass.functions.text import compact, count_true, flag

WORD_START, WORD_END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def lexicon_score(mail: DataFrame, text: str = "raw") -> DataFrame:
    """Urgent terms and threat patterns, softer in a business context."""
    df = mail.withColumn("_low", F.lower(F.col(text)))
    business = F.lit(False)
    for term in rules.BUSINESS_TERMS:
        business = business | F.contains("_low", F.lit(term))
    df = df.withColumns({
        "business_context": business,
        "urgent_terms": count_true(F.contains("_low", F.lit(t)) for t in rules.URGENT_TERMS),
        "threat_patterns": count_true(matches(F.col("_low"), p) for p in rules.THREAT_PATTERNS)})

    def points(count: str) -> Column:
        n = F.col(count)
        return F.when(F.col("business_context"), F.least(F.lit(0.1) * n, F.lit(0.3))).otherwise(F.least(F.lit(0.15) * n, F.lit(0.5)))

    urgent, threat, ctx = F.col("urgent_terms") > 0, F.col("threat_patterns") > 0, F.col("business_context")
    return df.withColumns({
        "content_risk": points("urgent_terms") + points("threat_patterns"),
        "content_factors": compact([
            flag(urgent & ctx, "Contains urgent business-related terms"), flag(urgent & ~ctx, "Contains high-urgency language"),
            flag(threat & ctx, "Contains business-related warnings"), flag(threat & ~ctx, "Contains threats or consequences")]),
    }).drop("_low")


def matches(low: Column, pattern: str) -> Column:
    """Whether a lower-case text matches a rule pattern. The plain texts that every
    match has one of are looked for first: a byte search settles almost every text."""
    texts = needed(pattern)
    if texts == [pattern]:
        return F.contains(low, F.lit(pattern))
    found = F.lit(not texts)
    for text in texts:
        found = found | F.contains(low, F.lit(text))
    return found & low.rlike(pattern)


def is_high_risk(label: str) -> bool:
    return any(word in label.lower() for word in rules.HIGH_RISK_WORDS)


def suspicious_url_hits(text: Column) -> Column:
    """Every match of the link patterns of the indicator bank."""
    found = []
    for name, pattern in rules.INDICATOR_URL_PATTERNS.items():
        matches = F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(0))
        if name == "plain_host":
            matches = F.filter(matches, lambda u: ~F.startswith(F.lower(u), F.lit("http://www.")))
        found.append(matches)
    return F.concat(*found)


def indicator_bank(table: DataFrame | None = None) -> PatternBank:
    """The built-in rules, or those of a table (ord, family, label, pattern)."""
    if table is not None:
        return PatternBank.of(table)
    return PatternBank(tuple((family, label, p) for family, (label, patterns) in rules.INDICATORS.items() for p in patterns))


def indicators(mail: DataFrame, text: str = "raw", bank: PatternBank | None = None) -> DataFrame:
    """Indicator list of each mail with counts by family.

    Rules are rows of a bank (:func:`indicator_bank`). A text is read once for the plain
    texts that the rules need, and only rules whose text is there are tried on it. The
    links' patterns come after the family ``request``, or last without one.
    """
    bank = bank or indicator_bank()
    df = mail.withColumns({
        "_low": F.lower(F.col(text)),
        "_urls": F.when(F.contains(F.lower(F.col(text)), F.lit("http")), suspicious_url_hits(F.col(text))).otherwise(F.array().cast("array<string>")),
        "capital_words": F.regexp_count(text, F.lit("(?=[A-Z]{2})" + WORD_START + "[A-Z]{2,}" + WORD_END)),
        "exclamations": F.length(text) - F.length(F.replace(text, F.lit("!")))})
    df = df.withColumn("_try", bank.worth_trying(F.col("_low")))
    df = df.withColumn("_hits", bank.matched(F.col("_low"), F.col("_try")))
    families = bank.families()
    df = df.withColumns({f"_{f}": bank.texts(bank.of_family(F.col("_hits"), f)) for f in families})
    severe = [is_high_risk(f"{label}: '{p}'") for _, label, p in bank.rules]
    is_severe = F.array(*map(F.lit, severe))
    high = F.size(F.filter("_hits", lambda i: is_severe[i]))
    extra = compact([
        flag(F.col("capital_words") > 3, F.concat(F.lit("Excessive capitalization: "), F.col("capital_words").cast("string"), F.lit(" instances"))),
        flag(F.col("exclamations") > 3, F.concat(F.lit("Excessive exclamation marks: "), F.col("exclamations").cast("string"), F.lit(" instances")))])
    links = F.transform("_urls", lambda u: F.concat(F.lit("Suspicious URL: '"), u, F.lit("'")))
    at = families.index("request") + 1 if "request" in families else len(families)
    ordered = F.concat(*[F.col(f"_{f}") for f in families[:at]], links, *[F.col(f"_{f}") for f in families[at:]], extra)
    counts = {f"n_{f}": F.size(f"_{f}") for f in families}
    df = df.withColumns({**counts, "n_url": F.size("_urls"), "high_risk": high + F.size("_urls"), "indicators": ordered})
    return df.withColumn("n_indicators", F.size("indicators")).drop("_low", "_urls", "_try", "_hits", *[f"_{f}" for f in families])


def blended_probability(knn: Column, n: Column, high: Column) -> Column:
    """Neighbour probability blended with the indicator score; more weight to
    the indicators the more of them there are."""
    base = F.least(F.lit(0.9), n * F.lit(0.08))
    score = F.least(F.lit(0.95), base + high * F.lit(0.05))
    weight = F.least(F.lit(0.8), n * F.lit(0.1))
    return F.when(n > 0, knn * (F.lit(1.0) - weight) + score * weight).otherwise(knn)


def hand_features(df: DataFrame, text: str = "text") -> DataFrame:
    """The eight hand-made features as columns f1 ... f8."""
    t = F.col(text)
    initials = "".join(sorted({w[0] for w in rules.SUSPICIOUS_TOKENS}))
    words = f"(?=[{initials}])" + WORD_START + "(?:" + "|".join(rules.SUSPICIOUS_TOKENS) + ")"
    return df.withColumns({
        "url_count": F.regexp_count(t, F.lit(U.HOST_ONLY)),
        "suspicious_words": F.regexp_count(F.lower(t), F.lit(words + WORD_END)),
        "reply_or_forward": t.rlike("(?i)^(?:Subject: Re:|Subject: Fwd:)").cast("int"),
        "text_length": F.length(t),
        "exclamation_count": F.length(t) - F.length(F.replace(t, F.lit("!"))),
        "dollar_count": F.length(t) - F.length(F.replace(t, F.lit("$"))),
        "ip_in_url": t.rlike(r"https?://\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}").cast("int"),
        "markdown_link": t.rlike(r"\[.*\]\(https?://.*\)").cast("int"),
    })


FEATURES = ["url_count", "suspicious_words", "reply_or_forward", "text_length", "exclamation_count",
            "dollar_count", "ip_in_url", "markdown_link"]


def keyword_elements(df: DataFrame, text: str, prediction: str) -> DataFrame:
    """One element row per keyword found, scored by the mail's prediction."""
    low = F.lower(F.col(text))
    found = compact(flag(F.contains(low, F.lit(k)), k) for k in rules.ELEMENT_KEYWORDS)
    return df.select("mail_id", F.explode(found).alias("keyword"), F.col(prediction).alias("_p")).select(
        "mail_id", F.lit("keyword").alias("type"), F.concat(F.lit("Suspicious keyword: "), "keyword").alias("description"),
        (F.lit(0.6) + F.col("_p") * F.lit(0.2)).alias("risk_score"))


# ---- image text ---------------------------------------------------------------------

HOMOGLYPH = r"https?://[^\s<>\"]+"
MENTION = "(?=[a-zA-Z0-9])" + WORD_START + r"(?:www\.)?(?:[a-zA-Z0-9][-a-zA-Z0-9]*\.)+[a-zA-Z]{2,}" + WORD_END


def text_hosts(text: Column) -> Column:
    """Lower-case hosts of the links in a text."""
    return F.transform(U.scan_urls(text, host_only=True), lambda u: F.lower(F.regexp_replace(u, "^https?://", "")))


def _foreign_host_with(token: str, own: str):
    return lambda h: F.contains(h, F.lit(token)) & (h != own) & ~F.endswith(h, F.lit("." + own))


def url_manipulation(images: DataFrame, text: str = "ocr_text") -> DataFrame:
    """Non-ASCII links and brand names in foreign hosts (high), cheap TLDs (medium).

    Hosts are those of links and those that stand in the text without a scheme.
    """
    t = F.col(text)
    df = domain_mentions(images, text).withColumns({
        "_odd": F.filter(F.regexp_extract_all(t, F.lit(HOMOGLYPH), F.lit(0)), lambda u: u.rlike(r"[^\x00-\x7F]")),
        "_hosts": F.concat("link_hosts", "mentioned_domains")}).drop("link_hosts", "mentioned_domains")
    brands = compact(flag(F.exists("_hosts", _foreign_host_with(token, own)), f"{label} impersonation")
                     for label, token, own in rules.IMPERSONATION_BRANDS)
    cheap = F.exists("_hosts", lambda h: F.substring_index(h, ".", -1).isin(rules.SUSPICIOUS_TLDS))
    df = df.withColumns({"_brands": brands, "_cheap": cheap})
    high = F.size("_odd") + F.size("_brands")
    medium = F.col("_cheap").cast("int")
    return df.withColumns({
        "has_manipulated_urls": (high + medium) > 0,
        "high_findings": high, "medium_findings": medium,
        "manipulated": F.concat(F.col("_odd"), F.col("_brands"), F.when(F.col("_cheap"), F.array(F.lit("Suspicious TLD detected")))
                                .otherwise(F.array().cast("array<string>"))),
        "manipulation_risk": F.least(F.lit(0.9), high * F.lit(0.3) + medium * F.lit(0.15)),
    }).drop("_odd", "_hosts", "_brands", "_cheap")


def domain_mentions(images: DataFrame, text: str = "ocr_text") -> DataFrame:
    """Hosts of links plus domains written without a scheme."""
    t = F.col(text)
    df = images.withColumn("link_hosts", text_hosts(t))
    bare = F.filter(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(MENTION), F.lit(0)), F.lower)),
                    lambda m: ~F.exists("link_hosts", lambda h: F.contains(h, m)))
    return df.withColumn("mentioned_domains", bare)


def typo_candidates(names: DataFrame) -> DataFrame:
    """(name, candidate) table of one-step misspellings of each name:
    substitution, insertion, deletion, transposition, look-alike characters.
    Meant for the fixed brand lists; its size is names x length x alphabet.
    """
    alphabet = F.array(*[F.lit(c) for c in rules.TYPO_ALPHABET])
    name, at = F.col("name"), F.col("at")
    size = F.length("name")
    left, here, right = F.left(name, at - 1), F.substring(name, at, F.lit(1)), F.substring(name, at + 1, size)
    spots = names.select("name", F.explode(F.sequence(F.lit(1), size + 1)).alias("at"))
    inner = spots.filter(at <= size)
    letters = lambda df: df.select("*", F.explode(alphabet).alias("c"))
    table = F.create_map(*[x for k, v in rules.LOOKALIKES.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    kinds = [
        letters(inner).filter(here != F.col("c")).select("name", F.concat(left, "c", right).alias("candidate")),
        letters(spots).select("name", F.concat(left, "c", F.substring(name, at, size)).alias("candidate")),
        inner.select("name", F.concat(left, right).alias("candidate")),
        inner.filter(at < size).select("name", F.concat(left, F.substring(name, at + 1, F.lit(1)), here,
                                                        F.substring(name, at + 2, size)).alias("candidate")),
        inner.select("name", F.explode(F.try_element_at(table, here)).alias("c"), left.alias("l"), right.alias("r"))
             .select("name", F.concat("l", "c", "r").alias("candidate")),
    ]
    out = kinds[0]
    for kind in kinds[1:]:
        out = out.union(kind)
    return out.distinct()


def fixed_names(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(n) for n in names])).alias("ord", "name"))


def match_typos(observed: DataFrame, names: list[str]) -> DataFrame:
    """Observed ``domain`` values that are a one-step misspelling of a name:
    a plain equality join against the candidate table."""
    table = typo_candidates(fixed_names(observed.sparkSession, names))
    return observed.join(table, observed["domain"] == table["candidate"]).filter(F.col("domain") != F.col("name")) \
        .select("domain", F.col("name").alias("similar_to"))


def brand_impersonation(images: DataFrame, text: str = "ocr_text", compat: bool = False) -> DataFrame:
    """First brand named in the text (a recognised logo wins) and whether a
    host in it imitates that brand: 0.9, brand with hosts 0.5, brand only 0.2.

    A host imitates when one of its labels is a one-step misspelling of the
    brand; ``compat`` flags every host without the brand.
    """
    low = F.lower(F.col(text))
    named = F.coalesce(*[F.when(F.contains(low, F.lit(b)), b) for b in rules.IMAGE_BRANDS])
    logo = F.col("logo_brand") if "logo_brand" in images.columns else F.lit(None).cast("string")
    df = domain_mentions(images, text).withColumn("brand", F.coalesce(logo, named))
    df = df.withColumns({"_brand": F.regexp_replace("brand", "[_ ]", ""), "_hosts": F.concat("link_hosts", "mentioned_domains")})
    if compat:
        mismatched = F.filter("_hosts", lambda h: ~F.contains(h, F.col("_brand")))
        df = df.withColumn("mismatched_hosts", F.coalesce(mismatched, F.array().cast("array<string>")))
    else:
        swaps = F.create_map(*[x for b in rules.IMAGE_BRANDS for name in (b.replace(" ", ""),) for x in (
            F.lit(name), F.array(*[F.lit(name[:i] + name[i + 1] + name[i] + name[i + 2:]) for i in range(len(name) - 1)]))])
        df = df.withColumn("_swaps", F.try_element_at(swaps, F.col("_brand")))

        def misspelt(word: Column) -> Column:
            """Same test as membership in typo_candidates, without the table."""
            near = (F.levenshtein(word, F.col("_brand"), 1) == 1) | F.array_contains("_swaps", word)
            return word.rlike("^[a-z0-9_-]+$") & near & (word != F.col("_brand"))

        df = df.withColumn("mismatched_hosts", F.coalesce(
            F.filter("_hosts", lambda h: F.exists(F.split(h, r"\."), misspelt)), F.array().cast("array<string>")))
    hit = F.col("brand").isNotNull() & (F.size("mismatched_hosts") > 0)
    out = df.withColumns({
        "is_impersonation": hit,
        "impersonation_risk": F.when(F.col("brand").isNull(), 0.0).when(hit, 0.9).when(F.size("_hosts") > 0, 0.5).otherwise(0.2),
        "found_hosts": F.size("_hosts")})
    return out.drop("_brand", "_hosts", "_swaps")


INLINE = r'src="data:image/([^;]+);base64,([^"]+)"'
LINKED = r'<img[^>]+src="(https?://[^"]+)"'


def extract_images(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per inline or linked image: source, type, MD5 of the bytes, link."""
    t = F.col(text)
    inline = F.transform(
        F.arrays_zip(F.regexp_extract_all(t, F.lit(INLINE), F.lit(1)).alias("kind"), F.regexp_extract_all(t, F.lit(INLINE), F.lit(2)).alias("data")),
        lambda z: F.struct(F.lit("inline").alias("source"), z["kind"].alias("type"), F.md5(F.unbase64(z["data"])).alias("hash"),
                           F.lit(None).cast("string").alias("url")))
    linked = F.transform(
        F.regexp_extract_all(t, F.lit(LINKED), F.lit(1)),
        lambda u: F.struct(F.lit("remote").alias("source"), F.regexp_extract(u, r"[^/]\.([^./]+)$", 1).alias("type"),
                           F.lit(None).cast("string").alias("hash"), u.alias("url")))
    return df.select(key, F.posexplode(F.concat(inline, linked)).alias("pos", "_i")).select(key, "pos", "_i.*")


def distinct_images(images: DataFrame, key: str) -> DataFrame:
    """One row per distinct inline image with its first carrier and use count."""
    return images.filter("hash IS NOT NULL").groupBy("hash").agg(
        F.count("*").alias("uses"), F.min(key).alias("first_seen"), F.min("type").alias("type"))


def analyze_images(images: DataFrame, text: str = "ocr_text") -> DataFrame:
    """Risk and factors of each image that is not a tracking pixel."""
    visible = images.filter((F.col("width") >= 20) & (F.col("height") >= 20))
    df = url_manipulation(brand_impersonation(visible, text), text)
    logo = F.col("logo_brand").isNotNull() if "logo_brand" in images.columns else F.lit(False)
    hits = [(F.col("is_impersonation"), "Brand impersonation detected", F.col("impersonation_risk")),
            (F.col("has_manipulated_urls"), "URL manipulation detected", F.col("manipulation_risk")),
            (F.col("found_hosts") > 0, "URLs embedded in image", F.lit(0.5))]
    worst = F.greatest(*[F.when(c, r) for c, _, r in hits])
    low = F.when((F.length(F.trim(F.col(text))) > 0) & logo, 0.3).otherwise(0.0)
    return df.withColumns({"image_factors": compact(flag(c, n) for c, n, _ in hits), "image_risk": F.coalesce(worst, low)})


IMAGE_FACTORS = ["Brand impersonation detected", "URL manipulation detected", "URLs embedded in image"]


def roll_up_images(images: DataFrame) -> DataFrame:
    """Per mail: number of images, analysed images, max risk, distinct factors."""
    analysed = analyze_images(images).groupBy("mail_id").agg(
        F.count("*").alias("analyzed_images"), F.max("image_risk").alias("image_risk"),
        *[F.bool_or(F.array_contains("image_factors", name)).alias(f"_f{i}") for i, name in enumerate(IMAGE_FACTORS)])
    counts = images.groupBy("mail_id").agg(F.count("*").alias("image_count"))
    df = counts.join(analysed, "mail_id", "left")
    return df.select("mail_id", "image_count", F.coalesce("analyzed_images", F.lit(0)).alias("analyzed_images"),
                     F.coalesce("image_risk", F.lit(0.0)).alias("image_risk"),
                     compact(flag(F.coalesce(f"_f{i}", F.lit(False)), name) for i, name in enumerate(IMAGE_FACTORS)).alias("image_factors"))
