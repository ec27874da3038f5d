"""I-Match fingerprints: the terms of a text inside a band of document frequency,
sorted and hashed once for each of several random subsets of the lexicon.

Everything is DataFrame expressions. Document frequencies are counted over all
texts by 64-bit term hash. The band's lower edge is a share of the documents, so
the lexicon has at most (mean distinct terms per text) / share terms however
large the corpus is. It is kept as one array of bits, which every row reads; a
term outside the band passes it with a chance of lexicon size / bits, the same
term always alike.

Subsets come in ``families``. Inside a family each subset keeps a random quarter
of the one before, so every text, however long, meets subsets of which it has few
terms, and an edit elsewhere leaves those unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailglass.llm.shared import materialize, text_of


@dataclass(frozen=True)
class Settings:
    """``least`` and ``most``: the band, as shares of all documents."""

    least: float = 0.001
    most: float = 0.02
    bits: int = 20
    families: int = 8
    levels: int = 5
    slices: int = 256
    slice_rows: int = 4000


WHITE = "[ \\t\\n\\x0B\\f\\r]+"


def terms(text: Column) -> Column:
    """Distinct 64-bit hashes of the words between white space, letters folded."""
    words = F.split(F.lower(text), WHITE)
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(texts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row, column ``lexicon``: bit i of long j is set if a term in the band hashes to 64 j + i. Written."""
    n = texts.count()
    counts = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").count()
    band = counts.filter((F.col("count") >= max(2.0, s.least * n)) & (F.col("count") <= max(2.0, s.most * n)))
    place = F.shiftrightunsigned("term", 64 - s.bits)
    words = band.select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int").bitwiseAND(F.lit(63))).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    size = 1 << (s.bits - 6)
    spread = texts.sparkSession.range(size).withColumnRenamed("id", "word").join(words, "word", "left")
    return materialize(spread.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"]).alias("lexicon")))


def _in_band(term: Column, table: Column, s: Settings) -> Column:
    place = F.shiftrightunsigned(term, 64 - s.bits)
    word = F.get(table, F.shiftright(place, 6).cast("int"))
    return F.call_function("shiftrightunsigned", word, place.cast("int").bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1


def _seeded(seed: int):
    return lambda t: F.xxhash64(t, F.lit(seed))


def _kept(shift: int, bits: int):
    """Terms of which ``bits`` bits from ``shift`` on are 0."""
    mask = ((1 << bits) - 1) << shift
    return lambda t: t.bitwiseAND(F.lit(mask)) == 0


def with_fingerprint(frame: DataFrame, text: str, table: DataFrame, name: str, s: Settings = Settings()) -> DataFrame:
    """Adds ``name``: families * levels hashes, level by level, then that of all terms; null where a text has no term of a subset.

    A text without a term in the band is fingerprinted by all its terms; one without
    any word gets nulls only. Equal texts get equal arrays, whatever the order of words.
    """
    columns = frame.columns
    # a scalar subquery: the lexicon is read once and is the same value for all rows
    found = frame.select(*columns, terms(F.col(text)).alias("_all"), table.scalar().alias("_lexicon"))
    found = found.select(*columns, "_all", F.filter("_all", lambda t: _in_band(t, F.col("_lexicon"), s)).alias("_band"))
    found = found.select(*columns, F.sort_array(F.when(F.size("_band") > 0, F.col("_band")).otherwise(F.col("_all"))).alias("_band"))
    a_hash = 60 // (2 * s.levels)  # families that one 64-bit hash has bits for
    seeds = range(-(-s.families // a_hash))
    found = found.select(*columns, "_band", *[F.transform("_band", _seeded(i)).alias(f"_s{i}") for i in seeds])
    own = [(f, f // a_hash, f % a_hash * 2 * s.levels) for f in range(s.families)]
    found = found.select(*columns, "_band", *[F.filter(f"_s{i}", _kept(shift, 2)).alias(f"_f{f}_0") for f, i, shift in own])
    for level in range(1, s.levels):
        found = found.select(*columns, "_band", *[f"_f{f}_{k}" for f, *_ in own for k in range(level)], *[F.filter(f"_f{f}_{level - 1}", _kept(shift + 2 * level, 2)).alias(f"_f{f}_{level}") for f, _, shift in own])
    hashes = [F.when(F.size(c) > 0, F.hash(c, F.lit(f))) for c, f in [(f"_f{f}_{level}", f) for level in range(s.levels) for f, *_ in own] + [("_band", -1)]]
    return found.select(*columns, F.array(*hashes).alias(name))


def as_text(fingerprint: Column) -> Column:
    """Eight hex digits a subset, joined; dashes stand for a subset without terms."""
    return F.array_join(F.transform(fingerprint, lambda h: F.coalesce(F.lower(F.right(F.lpad(F.hex(h), 8, "0"), F.lit(8))), F.lit("-" * 8))), "")


def likeness(a: Column, b: Column, s: Settings = Settings()) -> Column:
    """Share of equal hashes among the subsets of which either text has a term; 1 if both have none.

    Levels at which every subset has terms are too dense to tell partial likeness and are
    left out, other than the last level: equal texts are alike at all others anyway.
    """
    equal, either = F.lit(0), F.lit(0)
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    for level in range(s.levels):
        own = F.slice(pairs, level * s.families + 1, s.families)
        same = F.size(F.filter(own, lambda p: p["a"] == p["b"]))
        some = F.size(F.filter(own, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
        counts = (some < s.families) | F.lit(level == s.levels - 1)
        equal, either = equal + F.when(counts, same).otherwise(0), either + F.when(counts, some).otherwise(0)
    whole = F.size(F.filter(pairs, lambda p: ~p["a"].eqNullSafe(p["b"]))) == 0
    return F.when(whole, F.lit(1.0)).when(either == 0, F.lit(0.0)).otherwise(equal / either)


def with_next(frame: DataFrame, key: str, columns: list[str], s: Settings = Settings(), prefix: str = "next_") -> DataFrame:
    """Each row with ``columns`` of the row that follows in rising order of ``key`` (after the
    last: the first). A null key comes first; rows of one key follow each other by the first of ``columns``.

    Rows are dealt once, into slices of the key's range: bounds are quantiles, of which
    there are at most ``slices``, and equal parts between them. The first rows of each
    slice also go to the one before. Only the list of slices is ever in one place.
    """
    order = F.coalesce(F.col(key), F.lit(-(1 << 63)))
    n = frame.count()
    fine = max(1, n // (s.slices * s.slice_rows))
    steps = max(1, min(s.slices, n // s.slice_rows + 1))
    bounds = frame.agg(F.percentile_approx(order, [i / steps for i in range(steps + 1)], 100000)).first()[0] or [0]
    coarse, low, width = F.lit(0), F.lit(bounds[0]), F.lit(1.0)
    for i, (a, z) in enumerate(zip(bounds, bounds[1:])):
        inside = order >= F.lit(a)
        coarse, low = F.when(inside, F.lit(i)).otherwise(coarse), F.when(inside, F.lit(a)).otherwise(low)
        width = F.when(inside, F.lit(float(z) - float(a) + 1.0)).otherwise(width)
    part = F.least(F.greatest(F.floor((order.cast("double") - low.cast("double")) / width * fine), F.lit(0)), F.lit(fine - 1))
    keyed = frame.withColumn("_order", order).withColumn("_slice", (coarse * fine + part).cast("long"))
    firsts = materialize(keyed.select("_slice", "_order").groupBy("_slice").agg(F.min("_order").alias("_order")))  # at most slices * fine rows
    listed = Window.partitionBy(F.lit(0)).orderBy("_slice")
    before = firsts.withColumn("_before", F.lag("_slice").over(listed)).withColumn("_last", F.max("_slice").over(Window.partitionBy(F.lit(0)))).select(
        "_order", F.coalesce("_before", "_last").alias("_before"), F.col("_before").isNull().alias("_wraps"))
    guests = keyed.join(F.broadcast(before), "_order", "left")
    places = F.array(F.struct(F.col("_slice").alias("at"), F.lit(0).alias("turn")), F.struct(F.col("_before").alias("at"), F.when(F.col("_wraps"), 2).otherwise(1).alias("turn")))
    dealt = guests.select(*frame.columns, "_order", F.explode(F.filter(places, lambda p: p["at"].isNotNull())).alias("_place"))
    dealt = dealt.select(*frame.columns, "_order", F.col("_place.at").alias("_at"), F.col("_place.turn").alias("_turn"))
    following = Window.partitionBy("_at").orderBy(F.col("_turn") > 1, "_order", columns[0], "_turn")
    nexts = [F.lead(c).over(following).alias(f"{prefix}{c}") for c in columns]
    return dealt.select(*frame.columns, "_turn", *nexts).filter("_turn = 0").drop("_turn")


def fingerprint_documents(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced
    by the first as many (or all) of the next document's, by rising doc_id. A null
    text is empty; an only document is its own next one.
    """
    texts = documents.select("doc_id", text_of(documents).alias("text"))
    table = lexicon(texts, s)
    own = with_next(with_fingerprint(texts, "text", table, "own", s), "doc_id", ["text", "own"], s)
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = own.select("doc_id", n.cast("long").alias("n_chars"), "own", "next_own", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"))
    both = with_fingerprint(edited, "edited", table, "other", s)
    return both.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
                       likeness(F.col("own"), F.col("other"), s).alias("near_edited"), likeness(F.col("own"), F.col("next_own"), s).alias("near_next"))
