"""Where intermediate tables go, and how Arrow batches of text are read."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


Kept = TypeVar("Kept")
_kept: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], Kept]) -> Kept:
    """The one object that a Python worker keeps between tasks: what an operator remembers goes when another one's work begins."""
    if key not in _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """What an operator that keeps nothing calls in a worker, so that an earlier one's memory goes."""
    kept("nothing", lambda: None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where it is unset and the master is local (tests) a temporary folder is made and set as the checkpoint folder.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: operators need a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found if "://" in found else f"file://{found}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: computed once, and its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes what an operator wrote to the shared folder and nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Rows of an Arrow batch of whole texts.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """The same; from now on the session's Arrow batches have BATCH_ROWS rows at most (Spark's own bound of 10,000 is for short rows; of
    whole texts as many take memory twice, in the JVM and in Python)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(name)) > BATCH_ROWS:
        df.sparkSession.conf.set(name, BATCH_ROWS)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """What Catalyst expects to read from the files, in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n + 1 offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most: int = 2 << 20):
    """(first row, last row + 1) of runs of rows that hold about `most` bytes; a longer row is a run of its own."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last
