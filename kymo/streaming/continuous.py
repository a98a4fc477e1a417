"""Continuous daily aggregates: stored partial states and a log of the days that late rows made stale.

Raw rows are partitioned by day and batch. Landing a batch logs the days it touched; a refresh reads
the raw partitions of days logged since they were last refreshed, and no others, and replaces their
partial states. Every step overwrites partitions of its own, so a step that failed is run again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kymo.core import SUBJECT, Keys, calendar_frame, dbl
from kymo.operators.aggregates import local_date
from kymo.sources.sinks import overwrite_partitions
from kymo.streaming.runs import BATCH, read_log

DAY = "bucket"
TOUCHED = T.StructType([T.StructField(DAY, T.DateType())])


@dataclass(frozen=True)
class DailyAggregate:
    """Folders of one aggregate under ``path`` and what it adds up.

    ``schema`` is that of the raw rows (it may not hold ``bucket`` or ``batch_id``); ``cols`` are averaged
    per ``keys`` and local day of ``t``. NULL values do not count; rows without a time are refused.
    """

    path: str
    schema: T.StructType
    cols: tuple[str, ...]
    keys: Keys = SUBJECT
    t: str = "time"
    tz_offset: float = 0

    @property
    def raw(self) -> str:
        return f"{self.path}/raw"

    @property
    def partials(self) -> str:
        return f"{self.path}/partials"

    def states(self) -> T.StructType:
        counts = [T.StructField(f"{c}_n", T.LongType()) for c in self.cols]
        sums = [T.StructField(f"{c}_sum", T.DoubleType()) for c in self.cols]
        keys = [self.schema[k] for k in self.keys]
        return T.StructType([*keys, *counts, *sums, T.StructField("n", T.LongType()), T.StructField(DAY, T.DateType())])

    def raw_rows(self, spark: SparkSession) -> DataFrame:
        extra = [T.StructField(DAY, T.DateType()), T.StructField(BATCH, T.LongType())]
        return spark.read.schema(T.StructType([*self.schema.fields, *extra])).parquet(self.raw)


def _log(df: DataFrame, path: str, batch: int) -> None:
    overwrite_partitions(df.select(DAY).distinct().withColumn(BATCH, F.lit(batch).cast("long")), path, [BATCH])


def _logged(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], T.StructType([*TOUCHED.fields, T.StructField(BATCH, T.LongType())]))
    return read_log(spark, path, TOUCHED)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def land(df: DataFrame, to: DailyAggregate, batch: int) -> None:
    """Store a batch and log the days it touched. Landing the same batch again replaces it; the log is
    written last, so a batch without a log is one to land again. Usable from ``foreachBatch``."""
    spark = df.sparkSession
    day = local_date(to.t, to.tz_offset)
    placed = df.select(*to.schema.fieldNames(), day.alias(DAY), F.lit(batch).cast("long").alias(BATCH))
    held = placed.where(F.when(F.col(DAY).isNull(), F.raise_error(F.lit(f"row without {to.t}"))).otherwise(F.lit(True)))
    overwrite_partitions(held, to.raw, [DAY, BATCH])
    if _exists(spark, to.raw):
        _log(to.raw_rows(spark).where(F.col(BATCH) == batch), f"{to.path}/touched", batch)


def stale_days(spark: SparkSession, of: DailyAggregate, start=None, end=None) -> DataFrame:
    """(bucket, batch_id) logged and not yet refreshed, of days in [start, end)."""
    open_ = _logged(spark, f"{of.path}/touched").join(_logged(spark, f"{of.path}/done"), [DAY, BATCH], "left_anti")
    if start is not None:
        open_ = open_.where(F.col(DAY) >= F.lit(start).cast("date"))
    return open_ if end is None else open_.where(F.col(DAY) < F.lit(end).cast("date"))


def refresh(spark: SparkSession, of: DailyAggregate, start=None, end=None) -> list:
    """Recompute the partial states of stale days in [start, end) and return these days.

    Days outside stay stale for a later refresh. The days go through the driver (one value a day, 36,525 a
    century) because they must be known for the scan to prune. Batches that land meanwhile are not marked
    done, so their days stay stale.
    """
    found = stale_days(spark, of, start, end).collect()
    days = sorted({r[DAY] for r in found})
    if not days:
        return []
    fresh = of.raw_rows(spark).where(F.col(DAY).isin(days)).groupBy(*of.keys, DAY).agg(
        *[F.count(c).alias(f"{c}_n") for c in of.cols],
        *[F.sum(dbl(c)).alias(f"{c}_sum") for c in of.cols],
        F.count("*").alias("n"),
    )
    overwrite_partitions(fresh, of.partials, [DAY])
    marks = spark.createDataFrame([(r[DAY], r[BATCH]) for r in found], f"{DAY} date, {BATCH} long")
    marks.coalesce(1).write.mode("append").partitionBy(BATCH).parquet(f"{of.path}/done")
    return days


def partial_states(spark: SparkSession, of: DailyAggregate) -> DataFrame:
    return spark.read.schema(of.states()).parquet(of.partials)


def daily_means(spark: SparkSession, of: DailyAggregate, suffix: str = "_avg") -> DataFrame:
    """The rollup as last refreshed: count of rows and means per key and day."""
    means = [F.try_divide(f"{c}_sum", f"{c}_n").alias(f"{c}{suffix}") for c in of.cols]
    return partial_states(spark, of).select(*of.keys, DAY, "n", *means)


def trailing_means(spark: SparkSession, of: DailyAggregate, days: int, suffix: str = "_mean") -> DataFrame:
    """Means of all samples of the last ``days`` days, today included, combined from the states."""
    w = calendar_frame(of.keys, days - 1, include_today=True, date=DAY)
    over = [F.try_divide(F.sum(f"{c}_sum").over(w), F.sum(f"{c}_n").over(w)).alias(f"{c}{suffix}") for c in of.cols]
    return partial_states(spark, of).select(*of.keys, DAY, *over)
