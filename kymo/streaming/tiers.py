"""Last write wins over a stream, with batches merged by size tier.

A table is a set of runs. After batch n the runs are the digits of n + 1 written to the base ``fan``:
each batch adds one run, and wherever ``fan`` runs of a tier are complete they become one of the next
tier, sorted by key, with one row a key. A read opens at most (fan - 1) runs a tier, a row is
rewritten once a tier, and a hot key costs one row a run. Each batch commits the files of its runs as
one version of a ``FileTable``: a replayed batch finds its version and does nothing, a crash before the
commit changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kymo.sources import filetable as ft
from kymo.streaming.runs import BATCH, current_rows


def tiered_table(path: str, schema: T.StructType, keys: Sequence[str]) -> ft.FileTable:
    """The table of rows of ``schema``; its key columns must be orderable."""
    return ft.FileTable(path, T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())]), tuple(keys))


def _span(name: str) -> tuple[int, int]:
    """First and last batch of the run that a file belongs to."""
    first, last = name.split("-")[:2]
    return int(first), int(last)


def runs_of(spark: SparkSession, table: ft.FileTable) -> list[tuple[int, int]]:
    """First and last batch of each run that a read opens."""
    return sorted({_span(n) for n in ft.files(spark, table)})


def merged_from(batch: int, fan: int) -> int:
    """First of the batches that end up in one run with ``batch``."""
    span = 1
    while (batch + 1) % (span * fan) == 0:
        span *= fan
    return batch + 1 - span


def _newest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(BATCH, *order)).alias("_r")
    return rows.groupBy(*keys).agg(best).select(*keys, "_r.*")


def add_batch(df: DataFrame, table: ft.FileTable, batch: int, order: Sequence[str] = (), fan: int = 4, keep: int = 8) -> None:
    """Add one batch, merged with the runs before it that complete a tier. Files that the last ``keep``
    versions do not name are deleted now and then, so a reader has ``keep`` batches to finish."""
    spark = df.sparkSession
    done = ft.versions(spark, table)
    if done and done[-1] >= batch:
        return
    names = ft.files(spark, table)
    first = merged_from(batch, fan)
    joined = [n for n in names if _span(n)[0] >= first]
    rows = df.withColumn(BATCH, F.lit(batch).cast("long"))
    if joined:
        rows = rows.unionByName(ft.open_files(spark, table, joined))
    run = ft.new_folder(f"{first:012d}-{batch:012d}-")
    written = ft.write_files(_newest(rows, table.key, order), table, run)
    ft.commit(spark, table, [n for n in names if _span(n)[0] < first] + written, batch)
    if (batch + 1) % keep == 0:
        ft.drop_unnamed(spark, table, keep)


def current(spark: SparkSession, table: ft.FileTable) -> DataFrame:
    """The newest row of each key."""
    return current_rows(ft.read_table(spark, table), table.key)


def stream_upsert_tiered(
    sdf: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str] = (), fan: int = 4, keep: int = 8
) -> DataFrame:
    """Drain a stream into a tiered table and read it: per key the row of the last batch, then of the
    greatest ``order``. The checkpoint belongs to the table: batches are numbered by it."""
    table = tiered_table(path, sdf.schema, keys)
    query = (
        sdf.writeStream.outputMode("append")
        .foreachBatch(lambda df, batch: add_batch(df, table, batch, order, fan, keep))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return current(sdf.sparkSession, table)
