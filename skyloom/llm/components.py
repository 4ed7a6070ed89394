"""Connected components of an edge table by alternating star rounds.

Each round hangs every node's larger neighbours on its smallest one, then flattens the hanging; the
number of rounds grows with the logarithm of the longest path. Edges live in Spark tables only, and
each round's table goes to the shared checkpoint folder, so a lost executor costs one round at most.
A node with very many neighbours meets them where they are, so that no task gets them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import join_by_size, materialised


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the smallest of u and its neighbours; the minimum is summed before the shuffle."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return join_by_size(edges, least, ["u"], "n").drop("n")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches; roots are included.

    Nulls are no nodes; loops and repeated edges change nothing; no edges give no rows.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    star = materialised(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large)
        after = materialised(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .distinct()
        )
        same = after.join(star, ["u", "v"], "left_anti").isEmpty() and star.join(after, ["u", "v"], "left_anti").isEmpty()
        star = after
        if same:
            break
    found = star.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.union(star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
