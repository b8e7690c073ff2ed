"""Lineage cuts for loops: tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder is set only where that is unset in a local session.

    On a cluster it must be set: executors would write to disks of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if spark.sparkContext.getCheckpointDir() is None:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="netloom-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/netloom/{spark.sparkContext.applicationId}"


def place(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write and reread ``df``: the plan starts anew and survives lost executors."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`cut` that nothing will read any more, such as a loop's last but one."""
    own = re.sub(r"^\w+:/+", "/", _own(df.sparkSession))
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if own in re.sub(r"^\w+:/+", "/", folder):
            _delete(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Delete every table of this application that :func:`cut` has written."""
    _delete(spark, _own(spark))
