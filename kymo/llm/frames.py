"""Small helpers on frames: sides that may be broadcast, names that do not clash, workers' memory."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of a broadcast side; above them the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def small(df: DataFrame) -> DataFrame:
    """``df``, a few numbers a row, marked for broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def bounded(df: DataFrame, bytes_per_row: str) -> DataFrame:
    """``df`` marked for broadcast if its rows take at most ``BROADCAST_BYTES``, counted by the SQL
    expression ``bytes_per_row`` and 32 bytes for the rest of a row."""
    size = df.agg(F.sum(F.expr(bytes_per_row) + 32)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def free(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it, so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches; at the end of a partition the worker gives back the memory it has freed,
    so that workers kept for later stages do not hold the peaks of earlier ones."""

    def over(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return over


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return  # another C library


def settle(spark: SparkSession) -> None:
    """Give back what finished jobs hold in the driver: Python's freed memory, the plans that its dead
    frames keep in the JVM, and heap that the JVM no longer needs."""
    give_back()
    spark._jvm.System.gc()


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing will read again, and let Spark remove the shuffle files of
    jobs that are over: the cleaner waits for the driver to collect its garbage."""
    spark = staged[0].sparkSession
    for path in {file.rsplit("/", 1)[0] for df in staged for file in df.inputFiles()}:
        if "/kymo-stage/" in path:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    spark._jvm.System.gc()
