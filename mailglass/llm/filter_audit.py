"""How filters of a corpus interact: every order of them, by recursive enumeration.

Each row is read once and becomes a few numbers: its part, a digest of its text and a
mask with one bit per filter that it fails. Counts of equal masks ("cells") are all
that the enumeration sees, so its size depends on the number of filters and parts and
not on the rows. A recursive query starts at the cells' masks with the empty order
and extends each order by every unused letter, carrying the bits applied so far; each
level yields the metrics of that step.

Defined results: a null text is an empty one, a null part the empty string. A row
without an id never repeats a smaller id and has no labels. Rows that share an id are
documents of their own; an id has a label if any of its label rows has it. An empty
table gives no rows. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Callable
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailglass.llm.shared import materialize

#: In place of a condition: the text equals that of a row with a smaller id, anywhere in the table.
REPEATED = "repeated"
#: All orders of more filters than these would pass Spark's limit on rows of a recursion.
MOST_FILTERS = 6
BLANKS = r"[ \t-\r]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def too_short(text: Column, least: int) -> Column:
    return F.size(words(text)) < least


def repetitive(text: Column, percent: int) -> Column:
    """Fewer than ``percent`` of 100 words are distinct."""
    found = words(text)
    return F.size(F.array_distinct(found)) * 100 < F.size(found) * percent


def shouting(text: Column, percent: int) -> Column:
    """More than ``percent`` of 100 code points are capitals A to Z."""
    return F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * percent


def holds_any(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, "[^" + "".join("\\" + c for c in characters) + "]+", "")) > 0


def cells(documents: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column], Column] | str], part: str = "lang") -> DataFrame:
    """Counts per (part, mask): n, good and toxic documents.

    ``documents`` has doc_id, text and ``part``; ``labels`` has doc_id, quality, toxic.
    Bit k of the mask belongs to the k-th of ``filters``. Texts never move: what is
    shuffled is a digest, and equal rows are counted before that.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    mask = F.lit(0)
    repeated = 0
    for k, condition in enumerate(filters.values()):
        if condition == REPEATED:
            repeated |= 1 << k
        else:
            mask = mask.bitwiseOR(F.when(condition(text), 1 << k).otherwise(0))
    facts = materialize(documents.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), mask.alias("mask")))
    rows = facts.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    least = facts.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"))
    # a text's rows other than those of its smallest id are repeats; rows without an id are none and carry no label
    named = rows.filter(F.col("doc_id").isNotNull()).join(marks, "doc_id", "left").join(least, ["doc_id", "digest"], "left")
    named = named.withColumn("mask", F.when(F.col("first").isNull(), F.col("mask").bitwiseOR(F.lit(repeated))).otherwise(F.col("mask")))
    unnamed = rows.filter(F.col("doc_id").isNull()).groupBy("part", "mask").agg(F.sum("n").alias("n"))

    def total(flag: str) -> Column:
        return F.sum(F.when(F.col(flag), F.col("n")).otherwise(F.lit(0).cast("long")))

    counted = named.groupBy("part", "mask").agg(F.sum("n").alias("n"), total("is_good").alias("good"), total("is_toxic").alias("toxic"))
    nothing = F.lit(0).cast("long")
    both = counted.unionByName(unnamed.withColumns({"good": nothing, "toxic": nothing}))
    return both.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


#: mask cells join the empty order, then one unused letter more at each level
ENUMERATE = """
WITH RECURSIVE masks AS (SELECT DISTINCT mask FROM {cells}),
orders (prefix, letter, step, bit, before, mask) AS (
    SELECT '', '', 0, 0, 0, mask FROM masks
    UNION ALL
    SELECT prefix || l.letter, l.letter, step + 1, l.bit, before | bit, mask
    FROM orders LATERAL VIEW explode(filter(array(LETTERS), x -> ((before | bit) & x.bit) = 0)) unused AS l)
SELECT c.part, o.prefix, o.letter, o.step,
    sum(CASE WHEN c.mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN c.mask & before = 0 AND c.mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN c.mask & before <> 0 AND c.mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN c.mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN c.mask & before = 0 AND c.mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN c.mask & before = 0 AND c.mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
FROM orders o JOIN {cells} c ON c.mask = o.mask
WHERE o.step > 0
GROUP BY c.part, o.prefix, o.letter, o.step
"""


def steps(counted: DataFrame, letters: str) -> DataFrame:
    """One row per part and prefix of an order: what its last filter does after those before it."""
    if not 0 < len(letters) <= MOST_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"1 to {MOST_FILTERS} distinct letters, not {letters!r}")
    table = ", ".join(f"named_struct('letter', '{c}', 'bit', {1 << k})" for k, c in enumerate(letters))
    return counted.sparkSession.sql(ENUMERATE.replace("LETTERS", table), cells=counted)


def audit(documents: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column], Column] | str], part: str = "lang") -> DataFrame:
    """One row per part, order of all filters and step.

    Columns: part, filter_order, step, letter, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley (the filter's ``removed`` summed over all orders).
    """
    letters = "".join(filters)
    n = len(letters)
    found = materialize(steps(materialize(cells(documents, labels, filters, part)), letters))
    orders_after = F.element_at(F.array(*(F.lit(factorial(n - k)) for k in range(1, n + 1))), F.col("step"))
    shares = found.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders_after).alias("shapley"))
    full = found.filter(F.col("step") == n).select("part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    full = full.withColumn("prefix", F.expr("left(filter_order, step)"))
    return full.join(found, ["part", "prefix", "step"]).join(shares, ["part", "letter"]).select(
        "part", "filter_order", "step", "letter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
