"""What the operators share: intermediate tables, broadcasts, memory of workers, and how tables are read."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from ..intermediate import materialise, shared_dir

__all__ = ["bound_batches", "delete_table", "drop", "give_back", "materialise", "release", "share", "shared_dir", "table", "tidy"]

BATCH_BYTES = 8 << 20

_shared: list[Broadcast] = []


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most about ``BATCH_BYTES``, however long the texts are; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def share(spark: SparkSession, value) -> Broadcast:
    """A broadcast of a value of bounded size, until :func:`release`."""
    made = spark.sparkContext.broadcast(value)
    _shared.append(made)
    return made


def release() -> None:
    """Give back the executors' copies of what was shared; a plan that still needs one fetches it again."""
    while _shared:
        _shared.pop().unpersist()


def drop(shared: Broadcast) -> None:
    """Give up what was shared, the driver's own copy too, once no plan reads it any more."""
    if shared in _shared:
        _shared.remove(shared)
    shared.destroy()
    give_back()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving freed memory back when its task ends: Spark's Python workers live on between tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Return freed memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def delete_table(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialise` once nothing reads them any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
