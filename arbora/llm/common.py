"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, shared_dir, temporary

__all__ = ["BROADCAST_ROWS", "SPACE", "ascii_lower", "bound", "by_few", "cut", "free_name", "shared_dir", "small", "spread_join", "table", "temporary", "tidy", "uniform"]

#: The white space of every word and line rule here: blank, tab, line feed, vertical tab, form feed, return.
SPACE = r"\x20\x09-\x0D"
#: Rows that Spark hands to Python at once; its own 10,000 may be gigabytes here.
BATCH_ROWS = 128
#: Rows of a few numbers each that are broadcast at most, once they are counted.
BROADCAST_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """A-Z lower-cased and nothing else; the fast built-in does it where a text is ASCII."""
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))


def free_name(df: DataFrame, stem: str, *others: DataFrame) -> str:
    """A column name that neither df nor the others have, whatever the case of its letters."""
    taken = {c.lower() for d in (df, *others) for c in d.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def bound(value, then):
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def uniform(*columns):
    """A number in [0, 1) that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))


def by_few(df: DataFrame) -> DataFrame:
    """df, whose session then hands BATCH_ROWS rows at once to Python, unless it was told otherwise: rows here are whole texts, or lists of them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name) == "10000":
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def small(rows: DataFrame) -> DataFrame:
    """rows, a table of a few numbers each, to be broadcast if there are few enough of them, which is counted; else joined by shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def spread_join(rows: DataFrame, named: DataFrame, keys: list[str], by: list[str], counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """rows joined with named, which has one row for each of its keys, so that no key brings over a partition's fair share of rows to one task.

    Keys with more are dealt to several tasks, by a hash of the columns `by` of rows, and their rows of named go to each of those. counts (keys, n) says how
    many rows each key has, where the caller knows; it may leave out keys with few. At most as many keys as partitions are over the fair share, so
    their table is broadcast, and named grows by as many rows at most.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = cut(rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")) if counts is None else counts
    sums = counts.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    share = max(1, (sums["rows"] or 0) // partitions)
    if (sums["most"] or 0) <= share:
        return rows.join(named, keys, how)
    pieces, salt = free_name(rows, "pieces", named), free_name(rows, "salt", named)
    hot = F.broadcast(counts.filter(F.col("n") > share).select(*keys, F.least(F.lit(partitions), F.ceil(F.col("n") / share)).cast("int").alias(pieces)))
    missing = F.concat(*(F.col(k).cast("string") for k in keys)).isNull()  # null meets nothing, wherever it goes
    dealt = rows.join(hot, keys, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*by), F.when(missing, F.lit(partitions)).otherwise(F.col(pieces))).cast("int"), F.lit(0))).drop(pieces)
    copied = named.join(hot, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(pieces, F.lit(1)) - 1))).drop(pieces)
    return dealt.join(copied, [*keys, salt], how).drop(salt)


def tidy() -> None:
    """Gives back what a Python worker has freed: workers are used again, beside a JVM that needs the memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return
