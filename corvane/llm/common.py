"""Shared plumbing of the training-data operators: shared storage, batches and table access."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch handed to Python workers; bounds worker memory when texts are long.
BATCH_BYTES = 8 << 20
#: Rows of one Arrow batch handed to Python workers.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read lazily so that pruning reaches the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, where one machine is
    the whole cluster, may fall back to a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by driver and executors")
        found = "file://" + tempfile.mkdtemp(prefix="corvane-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; removed when the driver's interpreter ends."""
    path = f"{shared_dir(spark).rstrip('/')}/corvane-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote, once nothing reads it any more."""
    _remove(df.sparkSession, df.written_to)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in rows and bytes, so long texts can't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows over the cores when the scan yields fewer partitions than the cluster has cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= min(cores, 64):
        return df
    text = [F.xxhash64("text")] if "text" in df.columns else []  # null or repeated ids don't meet in one task
    return df.repartition(cores, *(F.col(k) for k in keys), *text)


def binary_texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of a binary column, nulls as empty."""
    for x in batch.column(batch.schema.get_field_index(column)):
        yield x.as_py() or b""


def long_array(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64))


def splitmix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (the finalizer of the public SplitMix64 generator)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
