"""Joins between daily tables and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.core import SUBJECT, Keys
from kymo.functions.clock import local_date

QUALITY_COLUMNS = ("is_valid_day", "completeness_pct", "wear_time_hours", "confidence_score")


def join_quality_left(daily: DataFrame, quality: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    return daily.join(quality, [*keys, "date"], "left")


def join_conditions_inner(
    daily: DataFrame,
    logs: DataFrame,
    quality: DataFrame | None = None,
    vri: DataFrame | None = None,
    t: str = "logged_at",
    tz_offset: float = 0,
    keys: Keys = SUBJECT,
) -> DataFrame:
    """Condition logs with their day's summary; several logs a day fan out the day row.

    All joins share (keys, date), so one shuffle of each side serves the whole chain.
    """
    on = [*keys, "date"]
    out = logs.withColumn("date", local_date(t, tz_offset)).join(daily, on)
    if quality is not None:
        out = out.join(quality, on, "left").where(F.coalesce(F.col("is_valid_day"), F.lit(True)))
    if vri is not None:
        out = out.join(vri, on, "left")
    return out


def latest_log_per_day(
    logs: DataFrame, t: str = "logged_at", tie: str = "id", tz_offset: float = 0, keys: Keys = SUBJECT
) -> DataFrame:
    """Latest row per (keys, local date), largest ``tie`` on equal times; map-side combined."""
    dated = logs.withColumn("date", local_date(t, tz_offset))
    group = [*keys, "date"]
    rest = [c for c in dated.columns if c not in group]
    best = F.max_by(F.struct(*rest), F.struct(F.col(t), F.col(tie))).alias("_r")
    return dated.groupBy(*group).agg(best).select(*group, "_r.*")


def count_pairs(
    logs: DataFrame, daily: DataFrame, quality: DataFrame, t: str = "logged_at", keys: Keys = SUBJECT,
    tz_offset: float = 0,
) -> DataFrame:
    """Number of (log, valid day) pairs per key. Logs are counted per day before the join."""
    on = [*keys, "date"]
    per_day = logs.groupBy(*keys, local_date(t, tz_offset).alias("date")).agg(F.count("*").alias("_n"))
    invalid = quality.where(~F.col("is_valid_day")).select(*on)
    return (
        per_day.join(daily.select(*on), on)
        .join(invalid, on, "left_anti")
        .groupBy(*keys)
        .agg(F.sum("_n").alias("pairs"))
    )


def daily_context(
    daily: DataFrame, tables: dict[str, DataFrame], keys: Keys = SUBJECT
) -> DataFrame:
    """One row per (keys, date): the day and every score table as nested structs.

    Each table holds at most one row per (keys, date); its struct is NULL when it has none.
    """
    on = [*keys, "date"]
    measures = [c for c in daily.columns if c not in on]
    out = daily.select(*on, F.struct(*measures).alias("biometrics"))
    for name, table in tables.items():
        fields = [c for c in table.columns if c not in on]
        out = out.join(table.select(*on, F.struct(*fields).alias(name)), on, "left")
    return out
