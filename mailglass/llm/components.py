"""Connected components of a table of links, by alternating star contraction.

Each round points every node at the smallest node that a neighbour knows. Links
are rows throughout; only row counts and sums reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailglass.llm.shared import materialize

#: Links for each task of a round: few links are dealt to few tasks, whatever the number of shuffle partitions.
LINKS_A_TASK = 1 << 14


def _towards(links: DataFrame, larger_only: bool) -> DataFrame:
    """Point the neighbours of each node at the smallest node around it."""
    least = links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root"))
    joined = links.join(least, "a")
    moved = joined.filter("b > a" if larger_only else "true").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return moved if larger_only else moved.unionByName(least.select("a", F.col("root").alias("b")))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node it reaches.

    Null ends and links of a node to itself are left out; repeated links do not matter.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    last, n = None, edges.count()
    for _ in range(rounds):
        tasks = max(1, -(-n // LINKS_A_TASK))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _towards(both, True).filter("a <> b").coalesce(tasks).distinct().coalesce(tasks)
        # each node's links to smaller ones: all of them, and the node itself, go to the smallest
        small = _towards(large, False).filter("a <> b").coalesce(tasks).distinct().coalesce(tasks)
        edges = materialize(small)
        state = edges.agg(F.count("*"), F.sum(F.col("a").cast("decimal(30,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        last, n = state, state[0]
    raise RuntimeError(f"links did not contract in {rounds} rounds")
