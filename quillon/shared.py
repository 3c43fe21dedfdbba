"""The folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. It is set here only where it is unset and all executors are this machine (tests); on a
    cluster it must be set."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"/tmp/quillon-checkpoints-{context.applicationId}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that name in any store that Spark reads."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


_written: list[str] = []


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: computed once, and its lineage ends there. It stays there until
    :func:`discard`."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df as the side of a join that grows with the other side: both are shuffled and merged. Spark takes a table's
    compressed bytes for its size and would send millions of narrow rows through the driver to every worker."""
    return df.hint("merge")


def discard(spark: SparkSession) -> int:
    """Deletes the tables that :func:`kept` has written in this process, once results that read them have been written
    themselves; how many there were."""
    found = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return found
