"""Steps over neighbouring rows: segments, runs, best of equals, places among equals; and differences of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


def segments(df: DataFrame, keys: list[str], order: list[Column], barrier: Column) -> DataFrame:
    """df with segment: how many barriers stand before a row or at it; what is between two may be ordered by itself."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("segment", F.sum(F.when(barrier, 1).otherwise(0)).over(upto))


def runs(df: DataFrame, keys: list[str], order: str, value: Column, least: int = 2) -> DataFrame:
    """Runs of at least so many rows in a row with the same value: keys, value, first, last and n."""
    by = Window.partitionBy(*keys).orderBy(order)
    changed = df.withColumn("value", value).withColumn("_new", F.when(F.col("value").eqNullSafe(F.lag("value").over(by)) & (F.row_number().over(by) > 1), 0).otherwise(1))
    numbered = changed.withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    found = numbered.groupBy(*keys, "_run").agg(F.first("value").alias("value"), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    return found.filter(F.col("n") >= least).drop("_run")


def best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def top(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, with rank. Spark limits each task's groups before the shuffle, so a hot key is k rows a task."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def places(df: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """Which of its key's places a row has, from 1; rows at one place share the number."""
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order)))


def placed_well(df: DataFrame, keys: list[str], position: str, order: str) -> DataFrame:
    """df with sorted: whether a row's neighbours by position don't come the wrong way round by order."""
    by = Window.partitionBy(*keys).orderBy(position)
    fine = F.coalesce(F.lag(order).over(by) <= F.col(order), F.lit(True)) & F.coalesce(F.lead(order).over(by) >= F.col(order), F.lit(True))
    return df.withColumn("sorted", fine)


def insertion_points(new: DataFrame, siblings: DataFrame, keys: list[str], order: str, position: str) -> DataFrame:
    """new with before: the position of the first sibling of its keys that sorts after it, or null for the end."""
    after = new.select(*keys, order).distinct().join(siblings.select(*keys, F.col(order).alias("_o"), F.col(position).alias("_p")), keys).filter(F.col("_o") > F.col(order))
    return new.join(after.groupBy(*keys, order).agg(F.min("_p").alias("before")), [*keys, order], "left")


def lost(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of before whose keys are not in after."""
    return before.join(after, keys, "left_anti")


def broken(before: DataFrame, after: DataFrame, all_of: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of all_of that before knew and after doesn't."""
    return all_of.join(before, keys, "left_semi").join(after, keys, "left_anti")


def linked(rows: DataFrame, targets: DataFrame, exact: list[str], loose: list[str], order: list[str], out: str) -> DataFrame:
    """rows with out of their target: by all exact keys, or else of the first target, in order, by the loose ones."""
    hit = targets.select(*exact, F.col(out).alias("_exact"))
    first = targets.groupBy(*loose).agg(F.min_by(out, F.struct(*order)).alias("_loose"))
    return rows.join(hit, exact, "left").join(first, loose, "left").withColumn(out, F.coalesce("_exact", "_loose")).drop("_exact", "_loose")


def adopted(first: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """first, and of more what first has no row for."""
    return first.unionByName(more.join(first, keys, "left_anti"))


def grouped_lines(found: DataFrame) -> DataFrame:
    """A row for each file and line of found (path, line, column), with its columns in order and how many there are."""
    return found.groupBy("path", "line").agg(F.sort_array(F.collect_list("column")).alias("columns"), F.count("*").alias("n"))


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with each row's number in the order, from 1; equal rows in any order, always the same once written.

    Rows are dealt to tasks by ranges of the order and numbered there; only how many each range has meets in one task.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn(name, own).join(F.broadcast(sizes), "_range").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_range", "_before")
