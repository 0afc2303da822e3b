"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, or a fresh one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return context._jsc.sc().getCheckpointDir().get()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="textsketch-"))
    return context._jsc.sc().getCheckpointDir().get()


def fresh(spark: SparkSession) -> str:
    """A path in it that nothing has, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/textsketch-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, and survives lost executors."""
    path = fresh(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of input for each core below which rows are dealt anew before a kernel: a small file is often one task, whatever its size in splits.
SMALL = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it is so small that its files may not be; larger inputs have tasks enough and are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SMALL else df


#: Bytes of texts that a kernel works on at once.
STRETCH = 1 << 20


def stretches(batch: pa.RecordBatch, column: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about STRETCH bytes of a text column, so that what a kernel makes of them stays small however long texts are."""
    if not len(batch):
        return
    size = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.nonzero(np.diff(size // STRETCH))[0] + 1).tolist(), len(batch)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(low, high - low)


@atexit.register
def release() -> None:
    """Delete what was written there; results that still read it go stale."""
    while _made:
        spark, path = _made.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            pass
