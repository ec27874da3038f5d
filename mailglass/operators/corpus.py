"""Corpus preparation: union, deduplication, balancing, splits, generated rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailglass import rules
from mailglass.functions.ranking import hash_cut, hash_index, hash_key

SEED = 42


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All corpora under one schema; columns a corpus lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def deduplicate(df: DataFrame, text: str = "body", order: tuple[str, ...] = ("source_ord", "id")) -> DataFrame:
    """First row of each distinct text in the given order; rows without a text
    count as one text, too.

    Only (digest, order key) pairs are grouped, with partial aggregation, so a
    text with very many copies costs one small row per map task. The full rows
    are then picked by their unique order key.
    """
    digest = F.coalesce(F.sha2(F.col(text), 256), F.lit("-"))
    first = df.groupBy(digest.alias("_digest")).agg(F.min(F.struct(*order)).alias("_first"))
    return df.join(first.select(*[F.col(f"_first.{c}").alias(c) for c in order]), list(order), "left_semi")


def balance(df: DataFrame, label: str = "is_phishing", key: str = "id", seed: int = SEED) -> DataFrame:
    """Each class reduced at random to the size of the smallest."""
    return hash_cut(df, key, seed, {"keep": F.col("_smallest")}, group=label, alias="_kept").drop("_kept")


def shuffle(df: DataFrame, key: str = "id", seed: int = SEED) -> DataFrame:
    """Rows in a repeatable random order (a range-partitioned sort)."""
    return df.orderBy(hash_key(F.col(key), seed), key)


def with_position(df: DataFrame, key: str = "id", seed: int = SEED, alias: str = "position") -> DataFrame:
    """Position of each row in that order, without sorting the whole table."""
    return hash_index(df, key, seed, alias)


def split(df: DataFrame, test: float = 0.2, validation: float = 0.1, label: str = "is_phishing", key: str = "id",
          seed: int = SEED) -> DataFrame:
    """Stratified test / validation / train labels. The validation share is
    taken from what the test share leaves, as validation / (1 - test)."""
    total = F.col("_total")
    n_test = F.ceil(F.round(total * F.lit(test), 6))
    n_val = F.ceil(F.round((total - n_test) * F.lit(validation / (1 - test)), 6)) if validation else F.lit(0)
    cuts = {"test": n_test, "validation": n_test + n_val} if validation else {"test": n_test}
    return hash_cut(df, key, seed, cuts, group=label, alias="split", rest="train")


def class_counts(df: DataFrame, label: str = "is_phishing") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def sample_at_most(df: DataFrame, n: int, key: str = "id", seed: int = SEED) -> DataFrame:
    """At most ``n`` rows chosen at random."""
    return hash_cut(df, key, seed, {"keep": F.lit(n)}, alias="_kept").drop("_kept")


def render_feed(feed: DataFrame, url: str = "url") -> DataFrame:
    """A short labelled mail text around each address of a link feed."""
    text = F.replace(F.lit(rules.FEED_MAIL), F.lit("{url}"), F.col(url))
    return feed.select("*", text.alias("text"), F.lit("phishing").alias("label"))


# --- generated texts ----------------------------------------------------------------
# Templates and fillers are tables of the caller. Each has an idx column that runs
# from 0 without gaps; rows are drawn by a digest of the seed row's key.


def pick_index(key: Column, part: str, n: int, seed: int = SEED) -> Column:
    """Index below ``n`` drawn from a digest of key, part name and seed."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{part}:{seed}")))
    return F.conv(F.left(digest, F.lit(7)), 16, 10).cast("long") % n


def draw(df: DataFrame, table: DataFrame, part: str, columns: dict[str, str], key: str = "id", seed: int = SEED) -> DataFrame:
    """Add ``columns`` (name in ``table``: new name) of the table row drawn for each row; nulls from an empty table."""
    n = table.agg(F.max("idx") + 1).first()[0] or 1
    drawn = table.select(F.col("idx").cast("long").alias("_at"), *[F.col(c).alias(new) for c, new in columns.items()])
    return df.withColumn("_at", pick_index(F.col(key), part, n, seed)).join(drawn, "_at", "left").drop("_at")


def fill(template: Column, fillers: dict[str, Column]) -> Column:
    for name, value in fillers.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def synthetic_lures(seeds: DataFrame, templates: DataFrame, fillers: dict[str, DataFrame], key: str = "id", seed: int = SEED) -> DataFrame:
    """One labelled training text per seed row.

    ``templates`` has (idx, subject, body); a filler table (idx, value) replaces the
    placeholder of its name. ``{number}`` and ``{amount}`` are made from digits.
    """
    k = F.col(key)
    digits = pick_index(k, "number", 100000000, seed).cast("string")
    df = draw(seeds.select(key), templates, "template", {"subject": "_subject", "body": "_body"}, key, seed)
    values = {"number": F.lpad(digits, 8, "0"),
              "amount": F.concat(F.lit("$"), (pick_index(k, "amount", 900, seed) + 100).cast("string"), F.lit(".00"))}
    for name, table in fillers.items():
        df = draw(df, table, name, {"value": f"_{name}_"}, key, seed)
        values[name] = F.col(f"_{name}_")
    return df.select(k.alias("id"), F.concat(F.lit("Subject: "), F.col("_subject"), F.lit("\n\n"), fill(F.col("_body"), values)).alias("text"),
                     F.lit("phishing").alias("label"))


def marketing_mails(seeds: DataFrame, kinds: DataFrame, names: DataFrame, topics: DataFrame, generated_on: str, key: str = "id",
                    seed: int = SEED) -> DataFrame:
    """One legitimate marketing mail with JSON metadata per seed row.

    ``kinds`` has (idx, type, sender, subject, body, link, discounted), with the
    placeholders name, topic, percent, slug and, in the body, link; ``names`` and
    ``topics`` have (idx, value). The metadata of discounted kinds names a promotion.
    """
    columns = {c: f"_{c}" for c in ("type", "sender", "subject", "body", "link", "discounted")}
    df = draw(seeds.select(key), kinds, "kind", columns, key, seed)
    df = draw(draw(df, names, "name", {"value": "_name"}, key, seed), topics, "topic", {"value": "_topic"}, key, seed)
    df = df.withColumns({
        "_percent": (pick_index(F.col(key), "percent", 9, seed) + 1) * 5,
        "_slug": F.left(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":slug:{seed}"))), F.lit(12))})
    own = {"name": F.col("_name"), "topic": F.col("_topic"), "percent": F.col("_percent").cast("string"), "slug": F.col("_slug")}
    df = df.withColumn("_link", F.concat(fill(F.col("_link"), own), F.lit("#t="), F.left(F.sha1(F.col(key).cast("string")), F.lit(8))))
    promotion = F.when(F.col("_discounted"), F.struct(F.col("_percent").cast("int").alias("discount")))
    return df.select(
        F.col(key).alias("id"), fill(F.col("_subject"), own).alias("subject"), fill(F.col("_body"), {**own, "link": F.col("_link")}).alias("body"),
        F.col("_sender").alias("sender"), F.col("_type").alias("type"), F.lit(True).alias("is_marketing"),
        F.to_json(F.struct(F.col("_name").alias("name"), F.col("_topic").alias("topic"), F.col("_slug").alias("tracking_id"),
                           promotion.alias("promotion"))).alias("metadata"),
        F.lit(generated_on).alias("generation_date"), F.lit("generated").alias("source"))


def enlarge(corpus: DataFrame, kinds: DataFrame, names: DataFrame, topics: DataFrame, generated_on: str, share: float = 0.2, key: str = "id", seed: int = SEED) -> DataFrame:
    """Corpus plus ``share`` as many generated marketing mails (labelled 0),
    seeded by that share of its own rows."""
    chosen = hash_cut(corpus.select(key), key, seed, {"keep": F.floor(F.round(F.col("_total") * share, 6))}, alias="_kept")
    new = marketing_mails(chosen, kinds, names, topics, generated_on, key, seed).withColumn("is_phishing", F.lit(0))
    return corpus.unionByName(new, allowMissingColumns=True)
