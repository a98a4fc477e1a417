"""Running streams into tables, and recomputing open or past days."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kymo.core import SUBJECT, Keys
from kymo.operators.scan import running_cusum
from kymo.plans.features import in_range
from kymo.sources.sinks import overwrite_partitions

BATCH = "batch_id"


def run_append(sdf: DataFrame, out: str, checkpoint: str) -> None:
    """Drain an append-mode stream into a parquet table."""
    query = (
        sdf.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _write_batch(df: DataFrame, out: str, batch: int) -> None:
    (
        df.withColumn(BATCH, F.lit(batch).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(BATCH)
        .parquet(out)
    )


def run_updates(sdf: DataFrame, out: str, checkpoint: str, mode: str = "update") -> None:
    """Drain a stream into a log partitioned by batch. A replayed batch overwrites its own
    partition, so the log is exact after a restart."""

    query = (
        sdf.writeStream.outputMode(mode)
        .foreachBatch(lambda df, batch: _write_batch(df, out, batch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_log(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])).parquet(out)


def current_rows(log: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Latest version of each key: the last batch wins, then ``order`` within it. Combined
    map-side, so the many versions of a hot key never meet in one task."""
    rest = [c for c in log.columns if c not in keys and c != BATCH]
    best = F.max_by(F.struct(*rest), F.struct(BATCH, *order)).alias("_r")
    return log.groupBy(*keys).agg(best).select(*keys, "_r.*")


def stream_dedup_upsert(
    sdf: DataFrame, out: str, checkpoint: str, keys: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """Last write wins by key: rows are logged per batch and read through ``current_rows``."""
    run_updates(sdf, out, checkpoint, "append")
    return current_rows(read_log(sdf.sparkSession, out, sdf.schema), keys, order)


def stream_cusum(
    sdf: DataFrame,
    out: str,
    state: str,
    checkpoint: str,
    residual: str,
    mu: float,
    sigma: float,
    keys: Keys = SUBJECT,
    t: str = "time",
    tie: Sequence[str] = ("event_id",),
    k: float = 0.5,
    h: float = 4.0,
) -> DataFrame:
    """Control chart over a stream; each micro-batch goes on from a per-key state table.

    A batch is charted by prefix scans, so a key of any size is spread over tasks. Both the
    rows and the new state are written under the batch's own partition: a replay rewrites
    them from the state of the batch before.
    """
    spark = sdf.sparkSession
    schema = T.StructType(
        [
            *sdf.schema.fields,
            T.StructField("cusum_positive", T.DoubleType()),
            T.StructField("cusum_negative", T.DoubleType()),
            T.StructField("cusum_alert", T.BooleanType()),
        ]
    )
    states = T.StructType(
        [*[sdf.schema[c] for c in keys], T.StructField("cusum_positive", T.DoubleType()), T.StructField("cusum_negative", T.DoubleType())]
    )

    def write(df: DataFrame, batch: int) -> None:
        before = None if batch == 0 else read_log(spark, state, states).where(F.col(BATCH) == batch - 1).drop(BATCH)
        charted = running_cusum(df, residual, mu, sigma, keys, t, tie, k, h, before)
        _write_batch(charted, out, batch)
        done = read_log(spark, out, schema).where(F.col(BATCH) == batch)
        ends = F.max_by(F.struct("cusum_positive", "cusum_negative"), F.struct(t, *tie)).alias("_s")
        after = done.groupBy(*keys).agg(ends).select(*keys, "_s.*")
        if before is not None:
            after = after.unionByName(before.join(after.select(*keys), list(keys), "left_anti"))
        _write_batch(after, state, batch)

    query = (
        sdf.writeStream.outputMode("append")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return read_log(spark, out, schema).drop(BATCH)


def recompute_open_day(
    table: str,
    fn: Callable[[DataFrame], DataFrame],
    inputs: DataFrame,
    as_of,
    warmup: int = 60,
    end=None,
) -> DataFrame:
    """Recompute the days from ``as_of`` on and overwrite only their partitions; closed days
    are served from the table as they are."""
    last = inputs.agg(F.max("date").alias("d")).first()["d"] if end is None else end
    fresh = in_range(fn, inputs, as_of, last, warmup)
    overwrite_partitions(fresh, table, ["date"])
    return inputs.sparkSession.read.schema(fresh.schema).parquet(table)


def backfill_range(
    fn: Callable[[DataFrame], DataFrame], inputs: DataFrame, start, end, sink: str | None = None, warmup: int = 60
) -> DataFrame:
    """A score for every day of a range in one job; with ``sink`` its partitions are replaced."""
    out = in_range(fn, inputs, start, end, warmup)
    if sink is None:
        return out
    overwrite_partitions(out, sink, ["date"])
    return inputs.sparkSession.read.schema(out.schema).parquet(sink)
