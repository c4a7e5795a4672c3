"""Connected components by randomised contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


def _drawn(node: Column, number: int) -> Column:
    """What a node draws in a round: its own number in the first, where links mostly lead to smallest nodes, then a hash, which no two nodes share."""
    return F.xxhash64(node, F.lit(number)) if number else node


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node that an edge (a, b: long, not null) names; component is its smallest reachable node.

    Each round every node draws a number and points at the one that drew the least among itself and its neighbours; pointers
    lead to ever smaller draws, so following them twice is safe. Edges are then written anew between what their ends lead to. In
    what order nodes are numbered doesn't matter to the draws: a chain shrinks to about two fifths a round, anything denser faster, so rounds
    grow with the logarithm of the nodes and what they write sums up to a few times the edges. Nothing is gathered by component; repeated edges and
    loops are no matter, and no edges give no rows.
    """
    left = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    jumps: list[DataFrame] = []
    while edges_left := left.count():
        number = len(jumps)
        both = left.union(left.select("b", "a"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min_by("b", _drawn(F.col("b"), number)).alias("low"))
        first = least.select("node", F.when(_drawn(F.col("low"), number) < _drawn(F.col("node"), number), F.col("low")).otherwise(F.col("node")).alias("to"))
        second = first.select(F.col("node").alias("to"), F.col("to").alias("then"))
        jump = cut(first.join(second, "to").select("node", F.col("then").alias("to")), 2 * edges_left)
        at = lambda end: jump.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to"))  # noqa: E731, B023
        moved = left.join(at("a"), "a").join(at("b"), "b").filter("a_to <> b_to")
        left = cut(moved.select(F.greatest("a_to", "b_to").alias("a"), F.least("a_to", "b_to").alias("b")).distinct(), edges_left)
        jumps.append(jump)
    if not jumps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    ends = jumps.pop()
    while jumps:  # from the last round back, so that each step reads and writes the nodes of its own round only
        jump = jumps.pop()
        ends = cut(jump.join(ends.select(F.col("node").alias("to"), F.col("to").alias("then")), "to", "left").select("node", F.coalesce("then", "to").alias("to")), jump.count())
    least = ends.groupBy("to").agg(F.min("node").alias("component"))
    return ends.join(least, "to").select("node", "component")
