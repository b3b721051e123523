"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum joined back to its edges, so a node with many
edges is pre-aggregated in the map tasks and its join can be split.  Each round
is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.storage import discard, settle

SLICES = 64


def slice_of(*cols: str) -> Column:
    """The slice of its class that a row is dealt to, by a hash of ``cols``.

    Rows grouped and joined by class and slice spread a large class over SLICES tasks; what a class as a whole needs is
    then computed over its at most SLICES groups.
    """
    return F.pmod(F.xxhash64(*cols), F.lit(SLICES)).cast("int")


def _least(edges: DataFrame) -> DataFrame:
    """``(u, m)``: the smallest ``v`` of every ``u``.

    The exchange of its own keeps the grouping out of the stage of the join that follows, so that adaptive execution
    can split the rows of a node with very many edges over several tasks.
    """
    return edges.groupBy("u").agg(F.min("v").alias("m")).repartition("u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least(edges)
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``: root is the smallest node reachable, itself included.

    An empty edge table gives an empty result; loops and repeated edges change nothing.
    """
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    stamp = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())
    seen = stamp(now)
    while seen[0]:
        after = settle(_small_star(_large_star(now)), "edges")
        found = stamp(after)
        discard(now)
        now = after
        if found == seen:
            break
        seen = found
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v"), F.col("v"))).distinct()
