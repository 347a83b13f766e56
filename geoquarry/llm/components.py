"""Connected components of a distributed edge table, by contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from geoquarry.llm.common import stash, unstash


def _jumped(parents: DataFrame) -> DataFrame:
    """Every node with its parent's parent."""
    above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
    return parents.join(above, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges -> (node, component): the smallest node reachable, for every node that has an edge.

    Each round deals every node a seeded number, and the node takes as parent the one of least number among itself and
    its neighbours; parents are followed twice over, and the edges are drawn between the parents. A node with
    neighbours keeps itself with probability one half at most, so a round is expected to halve the nodes whatever the graph looks
    like, chains included, and the rounds go on until no edge is left. Later rounds work on what has shrunk; at the
    end their tables are followed from the last to the first. Null ends and loops are ignored. All state stays in
    tables; only whether an edge is left reaches the driver.
    """
    left = stash(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while left.limit(1).count():
        number = lambda c, seed=len(rounds): F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("number"), F.col(c).alias("node"))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        chosen = both.groupBy("a").agg(F.min(number("b")).alias("near"))
        first = stash(chosen.select(F.col("a").alias("node"), F.least("near", number("a"))["node"].alias("parent")), "parents")
        parents = stash(_jumped(_jumped(first)), "parents")
        unstash(first)
        rounds.append(parents)
        drawn = reduce(lambda rows, c: rows.join(parents.select(F.col("node").alias(c), F.col("parent").alias(f"p{c}")), c), "ab", left).select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        # a parent that has one of its own stays linked to it
        upward = parents.select(F.col("parent").alias("node")).distinct().join(parents, "node").select(F.col("node").alias("a"), F.col("parent").alias("b"))
        new = drawn.unionByName(upward).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        new = stash(new.distinct(), "edges")
        unstash(left)
        left = new
    unstash(left)
    if not rounds:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    tops = rounds[-1]
    for parents in reversed(rounds[:-1]):
        tops = parents.join(tops.select(F.col("node").alias("parent"), F.col("parent").alias("top")), "parent", "left").select("node", F.coalesce("top", "parent").alias("parent"))
    tops = stash(tops, "tops")
    for parents in rounds:
        unstash(parents)
    least = tops.groupBy("parent").agg(F.min("node").alias("component"))
    return stash(tops.join(least, "parent").select("node", "component"), "components")
