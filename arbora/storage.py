"""Where results of a long job are kept, so that neither loops nor lost executors compute them again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="arbora-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: The folder of each application, made when it is first needed.
_FOLDERS: dict[tuple[str, str], str] = {}


def temporary(spark: SparkSession, stem: str) -> str:
    """A new place in the shared folder for what goes when the driver ends."""
    key = (spark.sparkContext.applicationId, shared_dir(spark))
    if key not in _FOLDERS:
        _FOLDERS[key] = f"{shared_dir(spark)}/arbora-{uuid.uuid4().hex}"
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_FOLDERS[key])
        files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)
    return f"{_FOLDERS[key]}/{stem}-{uuid.uuid4().hex}"


#: Rows of a few numbers that one task writes, where a table is known to be small.
TASK_ROWS = 100_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, computed once and written as a table in the shared folder, from which all later steps read.

    Unlike a checkpoint, a table has its own size as its statistics: in a loop of joins the estimates of a checkpoint multiply from round
    to round. The tables (cut-*) go when the driver ends, as results that are read later stand on them. rows: how many light rows there are at most, if that is known; few rows
    are written by few tasks then.
    """
    path = temporary(df.sparkSession, "cut")
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // TASK_ROWS)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
