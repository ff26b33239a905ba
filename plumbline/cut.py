"""Written cut points in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it.  Where it is unset, a temporary folder is set if
    the session runs on one machine; on a cluster that is an error, as executors would write to
    disks of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _paths(spark: SparkSession) -> list[str]:
    return _made.setdefault(spark.sparkContext.applicationId, [])


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
    _paths(spark).append(path)
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows written as Parquet and read back: a lost executor costs its running tasks only."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` to some tasks per core, however few bytes they have: for rows that are
    small as stored and long to work on."""
    spark = df.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def mark(spark: SparkSession) -> int:
    """A point to ``release`` back to."""
    return len(_paths(spark))


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Deletes the cut points made after ``since`` but for the last ``keep``; returns their number.
    Tables that still read them are lost, so call it when a query's rows have been saved."""
    paths = _paths(spark)
    gone = paths[since : len(paths) - keep]
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    paths[since : len(paths) - keep] = []
    return len(gone)


def finished(df: DataFrame, name: str, since: int) -> DataFrame:
    """The rows written; the cut points made after ``since`` on the way to them are deleted."""
    out = written(df, name)
    release(df.sparkSession, since, keep=1)
    return out
