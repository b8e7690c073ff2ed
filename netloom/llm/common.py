"""What the corpus operators share: shared scratch tables, byte words, Arrow passes.

Conventions of every operator here
----------------------------------
* Only the named columns of an input are read; further columns, also ones whose
  names look like an operator's own, are ignored (or carried through untouched
  where an operator returns documents).
* A null text counts as an empty text unless an operator says otherwise.
* A word is a maximal run of bytes other than space and 0x09-0x0D, which is what
  ``bytes.split()`` gives.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What an operator takes of an Arrow batch at a time; longer texts come alone.
SLICE_BYTES = 2 << 20
BATCH_ROWS = 1_000
_BATCH, _USUAL = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it. Only where that is unset in a local session, as
    in tests, is a temporary folder made and set; on a cluster that is an error, as
    executors would write to disks of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        if current is None:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="netloom-"))
            current = spark.sparkContext.getCheckpointDir()
        folder = current
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/netloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_ROWS`` in this session, unless it has a size of its own.

    Spark's usual 10,000 texts stand in the JVM and in the Python worker of every task.
    """
    if spark.conf.get(_BATCH) == _USUAL:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def shared_table(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage in a way that survives the loss of executors, and it gives the
    next plan real sizes to choose joins by.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete what :func:`shared_table` has written for this application."""
    _delete(spark, f"{scratch_dir(spark)}/netloom/{spark.sparkContext.applicationId}")


def drop_table(df: DataFrame) -> None:
    """Delete a table of :func:`shared_table` that nothing will read any more."""
    spark = df.sparkSession
    own = f"{scratch_dir(spark)}/netloom/"
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if own.split("://")[-1].lstrip("/") in folder:
            _delete(spark, folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def spark_schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of at most ``most`` bytes, or of one row."""
    n = batch.num_rows
    if n < 2 or batch.nbytes <= most:
        yield batch
    else:
        yield from slices(batch.slice(0, n // 2), most)
        yield from slices(batch.slice(n // 2), most)


def give_back() -> None:
    """Return a worker's free memory to the system: workers outlive their tasks, and the next stage gets others as well."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], ddl: str, start: Callable[[], object] | None = None) -> DataFrame:
    """``mapInArrow`` with one function per slice of a batch; ``start`` runs once per task and its value is passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start() if start else None
        for batch in batches:
            for part in slices(batch):
                out = fn(part, state) if start else fn(part)
                if out is not None and out.num_rows:
                    yield out
        state = part = batch = out = None
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, spark_schema(ddl))


def packed(df: DataFrame, **columns: Column) -> tuple[DataFrame, str]:
    """``df``'s columns in one struct under a name of its own, beside ``columns``; and that name.

    An operator can then add columns of any name; :func:`unpacked` gives the caller's back.
    """
    name = f"row_{uuid.uuid4().hex}"
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name), *[c.alias(k) for k, c in columns.items()]), name


def unpacked(df: DataFrame, name: str, columns: list[str], **changed: Column) -> DataFrame:
    return df.select(*[changed[c].alias(c) if c in changed else F.col(f"{name}.`{c}`").alias(c) for c in columns])


def skew_join(rows: DataFrame, side: DataFrame, key: str | list[str], weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``side``, which has each key once, with its number of rows in ``weight``.

    Keys with more than a thousandth of all rows, a thousand keys at most, are
    broadcast, so that their rows stay where they are; all others meet in a shuffle.
    ``side`` is read three times and should be a written table.
    """
    limit = max(1000, (side.agg(F.sum(weight)).first()[0] or 0) // 1000)
    if not side.where(F.col(weight) > limit).limit(1).count():
        return rows.join(side, key)
    hot = F.broadcast(side.where(F.col(weight) > limit))
    cold = rows.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti")
    return rows.join(hot, key).unionByName(cold.join(side.where(F.col(weight) <= limit), key))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
