"""Exact dedup as a stateful stream: disk-backed keyed state that never expires, and full bytes compared on each hit."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bound, cut, spread_join, temporary

#: State is kept in RocksDB; each batch saves its changes, and whole stores only now and then. Space isn't allotted ahead of need.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: Input files of a micro-batch.
BATCH_FILES = 256
#: What is kept of each row that was taken in.
ROWS = "doc_id long, file string, digest binary, sha binary"


def normalised(text: Column) -> Column:
    """The text with each run of white space replaced by one blank; single blanks are passed over."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _drained(query) -> None:
    query.awaitTermination()


def absorb(stream: DataFrame, folder: str, digest: Callable[[Column], Column] = sha256) -> None:
    """Takes a stream with doc_id and text into the state under folder: all that it has now, and what it has new at a later call.

    Each text is read, normalised and hashed once, into folder/rows. The state, in RocksDB on the executors' disks and kept in folder, holds a row
    for each digest and never lets one go: the digest, the smallest doc_id (the stable identifier), the file of the row with it (the content's
    locator) and the number of rows. Rows of a batch are summed up by digest where they are read, so a group of a third of all rows is
    a few rows a task. Each batch writes the state rows that it changed into folder/states/batch=N, where a repeated batch overwrites itself. Last, the
    hits are checked by whole texts: see verify().
    """
    spark = stream.sparkSession
    both = bound(normalised(F.col("text")), lambda norm: F.struct(digest(norm).alias("digest"), sha256(norm).alias("sha")))
    rows = stream.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_metadata.file_path").alias("file"), both.alias("both")).select("doc_id", "file", "both.digest", "both.sha")
    with _settings(spark, STATE):
        _drained(rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/reading").trigger(availableNow=True).start())
        taken = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", str(BATCH_FILES)).parquet(f"{folder}/rows")
        state = taken.groupBy("digest").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "file"))).alias("first"), F.min("file").alias("any_file"), F.count("*").alias("n"))

        def keep(batch: DataFrame, number: int) -> None:
            found = batch.select("digest", F.col("first.doc_id").alias("keep_id"), F.coalesce("first.file", "any_file").alias("locator"), "n")
            found.write.mode("overwrite").parquet(f"{folder}/states/batch={number}")

        _drained(state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).foreachBatch(keep).start())
    verify(spark, folder, _kinds(stream), digest)


def _kinds(rows: DataFrame) -> str:
    return ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", "text"))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _kept(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What was written to path, or nothing."""
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def _batches(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, f"{folder}/states", "digest binary, keep_id long, locator string, n long, batch long")


def states(spark: SparkSession, folder: str, after: int = -1) -> DataFrame:
    """(digest, keep_id, locator, n): what the state holds, by the last batch that changed each row; only of batches after the given one."""
    kept = _batches(spark, folder).filter(F.col("batch") > after)
    return kept.groupBy("digest").agg(F.max_by(F.struct("keep_id", "locator", "n"), "batch").alias("s")).select("digest", "s.*")


def _taken(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, f"{folder}/rows", ROWS)


def _contents(spark: SparkSession, files: list[str], kinds: str, digest: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, file, digest, norm) of all rows of the files."""
    read = spark.read.schema(kinds).parquet(*map(unquote, files))
    both = bound(normalised(F.col("text")), lambda norm: F.struct(norm.alias("norm"), digest(norm).alias("digest")))
    return read.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_metadata.file_path").alias("file"), both.alias("both")).select("doc_id", "file", "both.norm", "both.digest")


def _files(rows: DataFrame) -> list[str]:
    """Names of input files, all of which the driver listed before to read them."""
    return [r["file"] for r in rows.select("file").distinct().collect()]


def verify(spark: SparkSession, folder: str, kinds: str, digest: Callable[[Column], Column]) -> None:
    """Checks all hits of the batches since the last check by full bytes, and lists digests of unequal texts in folder/apart.

    A hit is a row of a digest that the state counts more than once. Its whole normalised text is compared with that of the row that the state
    points at, which is fetched from its locator's file. Where that content is gone the hit can't be checked, and this fails. Only hits' texts are shuffled (if
    their digests are too many to be broadcast, all texts once before); a digest of many rows is dealt to many tasks, and the pointed text goes to each of them.
    """
    last = _batches(spark, folder).agg(F.max("batch")).first()[0]
    done = _kept(spark, f"{folder}/verified", "upto long").agg(F.max("upto")).first()[0]
    if last is None or last == done:
        return
    several = cut(states(spark, folder, -1 if done is None else done).filter("n > 1"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = several.agg(F.sum("n").alias("rows"), F.count("*").alias("digests")).first()
    if sums["digests"]:
        share = max(1, sums["rows"] // partitions)
        placed = spread_join(_taken(spark, folder), several.select("digest"), ["digest"], ["doc_id", "file"], several.select("digest", "n"), "left_semi")
        files = _files(placed.unionByName(several.select(F.col("locator").alias("file")), allowMissingColumns=True))
        texts = _contents(spark, files, kinds, digest)
        light = several.select("digest", "keep_id", "locator")
        met = texts.join(F.broadcast(light), "digest") if sums["digests"] <= BROADCAST_ROWS else spread_join(texts, light, ["digest"], ["doc_id", "file"], several.select("digest", "n"))
        # At most as many digests as partitions have over a partition's share of the hits.
        hot = F.broadcast(several.filter(F.col("n") > share).select("digest", F.least(F.lit(partitions), F.ceil(F.col("n") / share)).cast("int").alias("pieces")))
        salt = F.coalesce(F.pmod(F.xxhash64("doc_id", "file"), F.col("pieces")).cast("int"), F.lit(0)).alias("salt")
        every = F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)).alias("salt")
        hits = cut(met.join(hot, "digest", "left").select("digest", salt, "norm", F.expr("file = locator AND doc_id <=> keep_id").alias("pointed")))
        pointed = hits.filter("pointed").groupBy("digest").agg(F.min("norm").alias("whole"))
        met = hits.join(pointed.join(hot, "digest", "left").select("digest", every, "whole"), ["digest", "salt"], "left")
        unequal = cut(met.filter("whole IS NULL OR norm <> whole").groupBy("digest").agg(F.bool_or(F.col("whole").isNull()).alias("lost")))
        if not unequal.filter("lost").isEmpty():
            raise RuntimeError(f"under {folder}, the content that a digest's state points at is gone from its file, so hits can't be checked")
        unequal.select("digest").write.mode("append").parquet(f"{folder}/apart")
    spark.createDataFrame([(last,)], "upto long").write.mode("append").parquet(f"{folder}/verified")


def groups(spark: SparkSession, folder: str, kinds: str = "doc_id long, text string", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row that was taken in, from what is under folder; no text is read again.

    Only rows of digests that verify() found to stand for unequal texts are grouped by their whole texts instead.
    """
    rows, held = _taken(spark, folder), cut(states(spark, folder))
    apart = _kept(spark, f"{folder}/apart", "digest binary").distinct()
    out = spread_join(rows, held.drop("locator"), ["digest"], ["doc_id", "file"], held.filter("n > 1").select("digest", "n")).select("doc_id", "keep_id", "n", "sha", "digest")
    if not apart.isEmpty():
        mixed = cut(_contents(spark, _files(rows.join(apart, "digest", "left_semi")), kinds, digest).join(apart, "digest", "left_semi"))
        split = mixed.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
        mended = mixed.join(split, ["digest", "norm"]).select("doc_id", "keep_id", "n", sha256(F.col("norm")).alias("sha"), "digest")
        out = out.join(apart, "digest", "left_anti").unionByName(mended)
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def dedup_table(spark: SparkSession, path: str, folder: str | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """groups() of the table at path, after its files went through the stream; with a folder of before, only its new files go.

    Texts are equal when identical after replacing each run of white space by one blank; null counts as empty. Of equal
    texts the row with the smallest doc_id stays; rows that share doc_id and text all stay, and count each. Rows with a null
    doc_id count but stay only where others name them: kept is false, and keep_id is null where the group has no id at all.
    An empty table gives an empty one; further columns are not looked at. With a folder of before, rows of files that have gone since are still there.
    """
    folder = folder or temporary(spark, "exact")
    plain = spark.read.parquet(path).select("doc_id", "text")
    pattern = path.rstrip("/")[:-1] + f"[{path.rstrip('/')[-1]}]"  # as a pattern a single file is taken as well as a folder
    stream = spark.readStream.schema(plain.schema).option("maxFilesPerTrigger", str(BATCH_FILES)).parquet(pattern)
    absorb(stream, folder, digest)
    return groups(spark, folder, _kinds(plain), digest)


def op10_stream_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_table() of all documents."""
    return dedup_table(spark, f"{sf_dir}/documents.parquet")


OP10_SQL = """
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM texts
"""
