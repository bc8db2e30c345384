"""The folder that the driver and all executors share, and files in it by any path that pyarrow knows."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder below spark.checkpoint.dir; only where that is unset, in local mode, below a temporary one. On a cluster that is an error."""
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="gaugewright-"))
        top = context._jsc.sc().getCheckpointDir().get()
    elif context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows of df, written as a Parquet table in the shared folder and read again, and the table's path."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as a Parquet table in the shared folder and read again."""
    return written_at(df, name)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or plain path."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
