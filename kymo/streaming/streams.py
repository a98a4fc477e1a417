"""Streaming operators: DataFrame in, streaming DataFrame out.

Windows carry a watermark, so state is bounded by lateness and not by history.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kymo.core import CUSUM_NOISE, SUBJECT, Keys, dbl, epoch_us


def stream_minute_hr(
    sdf: DataFrame, keys: Keys = SUBJECT, watermark: str = "10 minutes", t: str = "time", v: str = "bpm"
) -> DataFrame:
    """Tumbling 1-minute means, rounded half-even."""
    return (
        sdf.withWatermark(t, watermark)
        .groupBy(*keys, F.window(t, "1 minute").alias("_w"))
        .agg(F.bround(F.avg(dbl(v)), 0).cast("int").alias(v))
        .select(*keys, F.col("_w.start").alias("minute"), v)
    )


def stream_daily_rollup(
    sdf: DataFrame, cols: Sequence[str], keys: Keys = SUBJECT, watermark: str = "14 days", t: str = "time"
) -> DataFrame:
    """Tumbling 1-day means that stay open for two weeks of late data."""
    return (
        sdf.withWatermark(t, watermark)
        .groupBy(*keys, F.window(t, "1 day").alias("_w"))
        .agg(F.count("*").alias("n"), *[F.avg(c).alias(f"{c}_avg") for c in cols])
        .select(*keys, F.to_date("_w.start").alias("bucket"), "n", *[f"{c}_avg" for c in cols])
    )


def stream_hourly_sliding(
    sdf: DataFrame,
    keys: Keys = SUBJECT,
    width: str = "10 hours",
    slide: str = "1 hour",
    watermark: str = "1 hour",
    t: str = "time",
    v: str = "bpm",
) -> DataFrame:
    """Sliding means (linear in time, not wrapped around midnight)."""
    return (
        sdf.withWatermark(t, watermark)
        .groupBy(*keys, F.window(t, width, slide).alias("_w"))
        .agg(F.avg(dbl(v)).alias("mean"), F.count("*").alias("n"))
        .select(*keys, F.col("_w.start").alias("window_start"), "mean", "n")
    )


def stream_sleep_sessions(
    sdf: DataFrame, keys: Keys = SUBJECT, watermark: str = "1 hour", gap_seconds: int = 1800, t: str = "time"
) -> DataFrame:
    """Sessions that close ``gap_seconds`` after the latest stage end.

    A session extends to its running latest end; the batch operator compares with the
    previous row only, so the two differ where a stage lies inside an earlier one.
    """
    gap = F.concat((F.col("seconds") + gap_seconds).cast("string"), F.lit(" seconds"))
    return (
        sdf.withWatermark(t, watermark)
        .groupBy(*keys, F.session_window(t, gap).alias("_w"))
        .agg(F.count("*").alias("n_stages"), F.sum("seconds").alias("seconds"))
        .select(
            *keys,
            F.col("_w.start").alias("start"),
            F.timestamp_micros(epoch_us("_w.end") - gap_seconds * 1_000_000).alias("end"),
            "n_stages",
            "seconds",
        )
    )


CUSUM_STATE = T.StructType([T.StructField("up", T.DoubleType()), T.StructField("down", T.DoubleType())])


def stream_cusum_stateful(
    sdf: DataFrame,
    residual: str,
    mu: float,
    sigma: float,
    keys: Keys = SUBJECT,
    t: str = "time",
    row_id: str = "event_id",
    k: float = 0.5,
    h: float = 4.0,
) -> DataFrame:
    """Two-sided control chart with two numbers of state per key, for low-latency sources.

    The rows of one key in a micro-batch are sorted in one task, so the source must be rate
    limited. ``runs.stream_cusum`` has no such limit.
    """
    keys = list(keys)
    out_schema = T.StructType(
        [
            *[sdf.schema[c] for c in keys],
            sdf.schema[row_id],
            T.StructField("cusum_positive", T.DoubleType()),
            T.StructField("cusum_negative", T.DoubleType()),
            T.StructField("cusum_alert", T.BooleanType()),
        ]
    )

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up, down = state.get if state.exists else (0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["_t", row_id])
        ups, downs = [], []
        for z in (rows["_r"].to_numpy(dtype=float) - mu) / sigma:
            up, down = max(0.0, up + z - k), max(0.0, down - z - k)
            ups.append(up)
            downs.append(down)
        state.update((up, down))
        out = pd.DataFrame({row_id: rows[row_id].to_numpy(), "cusum_positive": ups, "cusum_negative": downs})
        for c, value in zip(keys, key):
            out[c] = value
        out["cusum_alert"] = (out["cusum_positive"] > h + CUSUM_NOISE) | (out["cusum_negative"] > h + CUSUM_NOISE)
        yield out[out_schema.fieldNames()]

    source = sdf.select(*keys, row_id, F.col(t).alias("_t"), dbl(residual).alias("_r")).where(F.col("_r").isNotNull())
    return source.groupBy(*keys).applyInPandasWithState(
        fold, out_schema, CUSUM_STATE, "append", GroupStateTimeout.NoTimeout
    )
