"""Hierarchies by parent links: ancestors, subtrees, nested sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .rows import numbered


def ancestors(nodes: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, ancestor, distance) of all proper ancestors, by doubling: paths of up to 2^k links after k joins.

    Deep trees take few rounds. Of a cycle, which is no tree, the shortest distance is kept for each pair, and the loop ends.
    """
    links = nodes.filter(F.col(parent).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("distance")).distinct()
    known = cut(links)
    while True:
        far = known.select(F.col("node").alias("mid"), F.col("ancestor").alias("further"), F.col("distance").alias("more"))
        longer = known.join(far, F.col("ancestor") == F.col("mid")).select("node", F.col("further").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        grown = cut(known.unionByName(longer).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")))
        if grown.count() == known.count():
            return grown
        known = grown


def within(nodes: DataFrame, roots: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """nodes that are one of roots (node) or below one: a frontier of children, level by level, joined by the parent only."""
    found = cut(nodes.join(roots.select(F.col(node)).distinct(), node, "left_semi"))
    edge = found
    while True:
        below = nodes.join(edge.select(F.col(node).alias(parent)).distinct(), parent, "left_semi")
        edge = cut(below.join(found, node, "left_anti"))
        if edge.isEmpty():
            return found
        found = cut(found.unionByName(edge.select(*found.columns)))


def nested_sets(paths: DataFrame, path: str = "path", group: str = "root") -> DataFrame:
    """pre and post numbers of each node of the trees that paths (arrays) span: below(x, y) is pre_x < pre_y <= post_x.

    Numbers count within a group (a column that all nodes of one tree share); a node is below another if its path starts with that one's.
    """
    whole = numbered(paths, [F.col(group).asc(), F.col(path).asc()], "pre")
    first = whole.groupBy(group).agg(F.min("pre").alias("_first"))
    ranked = cut(whole.join(first, group).withColumn("pre", (F.col("pre") - F.col("_first") + 1).cast("int")).drop("_first"))
    # post: the last node whose path starts with this one's. Each node reports itself to all its prefixes.
    up = ranked.select(group, "pre", F.explode(F.transform(F.sequence(F.lit(1), F.size(path)), lambda k: F.slice(F.col(path), F.lit(1), k))).alias(path))
    last = up.groupBy(group, path).agg(F.max("pre").alias("post"))
    return ranked.join(last, [group, path])


def is_within(pre: Column, start: Column, end: Column) -> Column:
    return (pre >= start) & (pre <= end)


def visible(scope_pre: Column, scope_post: Column, module_pre: Column) -> Column:
    """Public (no scope), or asked from within the scope."""
    return scope_pre.isNull() | is_within(module_pre, scope_pre, scope_post)
