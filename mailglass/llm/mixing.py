"""Mixing sources to target weights: budgets down a tree of domain, language and source.

A node's budget is shared among its children by weight. No child gets more than
it has (its tokens times the epochs allowed); what one cannot take goes to its
siblings by their weights, and only what all of them cannot take is short at the
parent, where its own siblings have been offered it in the same way. Budgets are
whole tokens, rounded down, so every engine computes the same ones.

Each leaf repeats its documents in seeded epochs: whole epochs, then the leading
documents of one more, in that epoch's order, until the budget is reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailglass.llm.shared import materialize

MISSING = ""


def count_words(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def epoch_key(doc_id: Column, epoch: Column | int, seed: int) -> Column:
    """Repeatable place of a row in an epoch's order: MD5 of id, epoch and seed."""
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), epoch.cast("string"), F.lit(f":{seed}")).cast("binary"))


def share_out(children: DataFrame, parents: DataFrame, on: list[str], name: str) -> DataFrame:
    """Budgets of children. ``children``: on, name, weight, capacity; ``parents``: on, budget.

    In rising order of capacity per weight, a child is full if its fair part of what
    is left, by the weights left, covers its capacity; from the first that is not, the
    rest is divided by weight. A child of weight 0 gets nothing.
    """
    order = [F.col("capacity") / F.col("weight"), F.col(name)]
    before = Window.partitionBy(*on, "_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*on, "_").orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    left = children.filter("weight > 0").withColumn("_", F.lit(0)).withColumn("_used", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("_weights", F.sum("weight").over(after))
    parents = parents.withColumn("_", F.lit(0))
    left = left.join(parents, [*on, "_"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    full = (wide("budget") - wide("_used")) * wide("weight") >= wide("capacity") * wide("_weights")
    left = left.withColumn("_full", full)
    # the state of the first child that is not full holds for all behind it
    edge = Window.partitionBy(*on, "_")
    first = F.min(F.when(~F.col("_full"), F.struct(F.col("capacity") / F.col("weight"), F.col(name), F.col("_used"), F.col("_weights")))).over(edge)
    left = left.withColumn("_first", first)
    part = F.floor((wide("budget") - F.col("_first._used").cast("decimal(20,0)")) * wide("weight") / F.col("_first._weights").cast("decimal(20,0)")).cast("long")
    return left.withColumn("budget", F.when(F.col("_full"), F.col("capacity")).otherwise(F.least(part, F.col("capacity")))).drop("_", "_used", "_weights", "_full", "_first")


def leaf_budgets(leaves: DataFrame, weights: DataFrame, levels: list[str], budget: Column | int, max_epochs: int) -> DataFrame:
    """levels, n_docs, tokens and budget of each leaf. ``weights``: level, node, weight (a
    whole number) for nodes by name; a node without one weighs 1, and one of weight 0 gets
    nothing. ``budget`` is an expression of ``capacity``, what the whole tree can take, or
    a number."""
    nodes = leaves
    for i, level in enumerate(levels):
        own = weights.filter(F.col("level") == level).select(F.col("node").alias(level), F.col("weight").cast("long").alias(f"_w{i}"))
        nodes = nodes.join(own, level, "left").withColumn(f"_w{i}", F.coalesce(f"_w{i}", F.lit(1).cast("long")))
    # what lies below a weight of 0 gets nothing, so nothing can be given to its ancestors for it
    reached = F.least(*(F.col(f"_w{i}") for i in range(len(levels))), F.lit(1).cast("long")) > 0
    nodes = nodes.withColumn("capacity", F.when(reached, F.col("tokens") * max_epochs).otherwise(0))
    parents = nodes.agg(F.coalesce(F.sum("capacity"), F.lit(0)).alias("capacity")).select(F.least(F.lit(budget) if isinstance(budget, int) else budget, F.col("capacity")).cast("long").alias("budget"))
    for depth, level in enumerate(levels):
        on = levels[:depth]
        children = nodes.groupBy(*on, level).agg(F.sum("capacity").alias("capacity"), F.first(f"_w{depth}").alias("weight"))
        parents = share_out(children, parents, on, level).select(*on, level, "budget")
    return leaves.join(parents, levels, "left").withColumn("budget", F.coalesce("budget", F.lit(0).cast("long")))


def mix(documents: DataFrame, weights: DataFrame, levels: list[str], budget: Column | int, max_epochs: int = 4, seed: int = 1, digits: int = 3) -> DataFrame:
    """Rows of ``documents`` to take: their columns, n_tokens and copies (1 or more).

    ``documents`` has the levels, doc_id and text. A null level is the node ''. A leaf
    with budget b and t tokens takes every document floor(b / t) times, and once more
    those that begin within the b mod t tokens left, in the order of the next epoch:
    the last of these is taken whole, so a leaf gets its budget and less than one
    document more. Texts without a word cost nothing: they come with each whole
    epoch of their leaf and in the last one where they begin before the cut; a leaf
    without any words is left out. Equal rows keep their place by the epoch's key, so
    they are taken or left together.

    The order inside a leaf is never sorted as a whole: places are counted by the
    first ``digits`` hex digits of the key, and rows are ordered inside one such slice.
    """
    named = documents.withColumns({c: F.coalesce(F.col(c), F.lit(MISSING)) for c in levels}).select(*levels, "doc_id", count_words(F.col("text")).alias("n_tokens"))
    narrow = materialize(named)
    leaves = narrow.groupBy(*levels).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    budgets = materialize(leaf_budgets(leaves, weights, levels, budget, max_epochs).filter("tokens > 0 and budget > 0").withColumn("whole", F.floor(F.col("budget") / F.col("tokens")).cast("int")).withColumn("rest", F.col("budget") % F.col("tokens")).select(*levels, "whole", "rest"))
    keyed = narrow.join(budgets, levels).withColumn("_key", epoch_key(F.col("doc_id"), F.col("whole"), seed)).withColumn("_slice", F.left("_key", F.lit(digits)))
    # rows with one key share a place
    places = keyed.groupBy(*levels, "_slice", "_key", "doc_id").agg(F.sum("n_tokens").alias("n"), F.first("whole").alias("whole"), F.first("rest").alias("rest"))
    slices = places.groupBy(*levels, "_slice").agg(F.sum("n").alias("n"))
    before = Window.partitionBy(*levels).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy(*levels, "_slice").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    begun = places.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(slices, [*levels, "_slice"])
    taken = begun.withColumn("copies", (F.col("whole") + (F.col("_before") + F.col("_inside") < F.col("rest")).cast("int"))).filter("copies > 0").select(*levels, F.col("doc_id").alias("_id"), "copies")
    own = documents.withColumns({f"_level{i}": F.coalesce(F.col(c), F.lit(MISSING)) for i, c in enumerate(levels)}).withColumn("n_tokens", count_words(F.col("text")))
    same = [F.col(f"_level{i}") == F.col(f"_t.{c}") for i, c in enumerate(levels)] + [F.col("doc_id").eqNullSafe(F.col("_id"))]
    condition = same[0]
    for x in same[1:]:
        condition = condition & x
    return own.join(taken.alias("_t"), condition).select(*[own[c] for c in documents.columns], own["n_tokens"], "copies")
