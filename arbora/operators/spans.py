"""Ranges of texts: containment, innermost range, overlap, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of the cells that ranges and points meet in.
CELL = 1024


def contains(start, end, point):
    return (start <= point) & (point < end)


def overlaps(a_start, a_end, b_start, b_end):
    return (a_start < b_end) & (b_start < a_end)


def containing(points: DataFrame, spans: DataFrame, keys: list[str], point: str = "offset", start: str = "start", end: str = "end", cell: int = CELL) -> DataFrame:
    """Pairs of a point and a range [start, end) of the same keys that holds it.

    A range is listed in each cell it touches, and a point in its own: an equi-join on keys and cell, with the exact test on top, so that a
    long text neither makes one task nor all its pairs. Ranges wider than 64 cells are listed in coarser ones, at each power of 64; points are asked for
    at those levels that some range has, a handful at most, which are looked up first.
    """
    width = F.greatest(F.lit(1), F.col(end) - F.col(start))
    level = F.greatest(F.lit(0), F.ceil(F.log(64.0, width / cell))).cast("int")
    wide = F.pow(F.lit(64), F.col("_level")) * cell
    listed = spans.withColumn("_level", level).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / wide).cast("long"), F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / wide).cast("long"))))
    levels = sorted(r[0] for r in spans.select(level.alias("level")).distinct().collect() if r[0] is not None)
    asked = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_cell", F.floor(F.col(point) / wide).cast("long"))
    both = asked.join(listed, [*keys, "_level", "_cell"])
    return both.filter(contains(F.col(start), F.col(end), F.col(point))).drop("_level", "_cell")


def innermost(points: DataFrame, spans: DataFrame, keys: list[str], point: str = "offset", start: str = "start", end: str = "end", span: str = "span") -> DataFrame:
    """points with the deepest range around each, or null: of nested ranges the one that starts last, of those that start alike the shortest."""
    found = containing(points.select(*keys, point).distinct(), spans.select(*keys, start, end, span), keys, point, start, end)
    best = found.groupBy(*keys, point).agg(F.max_by(span, F.struct(F.col(start), -F.col(end))).alias(span))
    return points.join(best, [*keys, point], "left")


def _islands(spans: DataFrame, keys: list[str], start: str, end: str, touch: bool) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(start).asc_nulls_last(), F.col(end).asc_nulls_last())
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = (F.col(start) > before) if touch else (F.col(start) >= before)
    return spans.withColumn("_new", F.when(before.isNull() | gap, 1).otherwise(0)).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def merged(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end", touch: bool = False) -> DataFrame:
    """The union of ranges, with how many went into each; those that only touch become one if asked. Unknown starts and ends come after known ones."""
    return _islands(spans, keys, start, end, touch).groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def overlapping(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """spans with clashes: whether one that comes before in the order of start and end reaches over its start."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("clashes", F.coalesce(before > F.col(start), F.lit(False)))


def around(spans: DataFrame, keys: list[str], at: int, context: int, start: str = "start", end: str = "end") -> DataFrame:
    """What holds the place at, and the context ranges that end before and start after it, nearest first, with side and rank."""
    holds = spans.filter(contains(F.col(start), F.col(end), F.lit(at))).withColumn("side", F.lit("containing"))
    before = spans.filter(F.col(end) <= at).withColumn("side", F.lit("before"))
    after = spans.filter(F.col(start) > at).withColumn("side", F.lit("after"))
    near = F.when(F.col("side") == "before", at - F.col(end)).otherwise(F.col(start) - at)
    ranked = holds.unionByName(before).unionByName(after).withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "side").orderBy(near, start, end)))
    return ranked.filter((F.col("side") == "containing") | (F.col("rank") <= context))
