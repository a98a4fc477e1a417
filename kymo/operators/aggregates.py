"""Grouped aggregates. All combine map-side; none collects a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kymo.core import SUBJECT, ColumnOrName, Keys, array_mad, array_median, calendar_frame, col, dbl, epoch_us, shift_hours
from kymo.functions.clock import age_at, local_date
from kymo.functions.vocab import SLEEP_STAGES, STAGES, map_stage_code
from kymo.operators.quantiles import attach, exact_quantiles, quantiles_wide

CONDITION_COLUMNS = (
    "overall", "mental", "physical", "energy", "overall_vas", "mood_vas", "energy_vas",
    "sleep_quality_vas", "stress_vas",
)


def rolling_daily_avg(
    df: DataFrame, t: str, cols: Sequence[str], keys: Keys = SUBJECT, suffix: str = "_avg", tz_offset: float = 0
) -> DataFrame:
    """One-day buckets of means (the materialised rollup, named for what it does)."""
    return df.groupBy(*keys, local_date(t, tz_offset).alias("bucket")).agg(
        *[F.avg(c).alias(f"{c}{suffix}") for c in cols]
    )


def minute_resample_mean(df: DataFrame, t: str, v: str, keys: Keys = SUBJECT) -> DataFrame:
    """1-minute means, rounded half-even to whole numbers."""
    return df.groupBy(*keys, F.date_trunc("minute", F.col(t)).alias("minute")).agg(
        F.bround(F.avg(dbl(v)), 0).cast("int").alias(v)
    )


def minute_resample_first(
    df: DataFrame, t: str, v: str, source_rank: str = "source_rank", keys: Keys = SUBJECT
) -> DataFrame:
    """First sample per minute; the highest-ranked source wins the minute."""
    order = F.struct(-F.col(source_rank), F.col(t), F.col(v))
    return df.groupBy(*keys, F.date_trunc("minute", F.col(t)).alias("minute")).agg(
        F.min_by(F.col(v), order).alias(v), F.max(source_rank).alias(source_rank)
    )


def grid_snap(
    df: DataFrame, t: str, v: str, minutes: int = 5, keys: Keys = SUBJECT, tz_offset: float = 0
) -> DataFrame:
    """Minute of the day to its nearest slot, last write wins; a sample rounding to midnight
    of the next day is dropped."""
    local = shift_hours(t, tz_offset)
    minute = F.hour(local) * 60 + F.minute(local)
    slot = F.floor(minute / F.lit(float(minutes)) + 0.5).cast("int")
    return (
        df.groupBy(*keys, F.to_date(local).alias("date"), slot.alias("slot"))
        .agg(F.max_by(F.col(v), F.struct(F.col(t), F.col(v))).alias(v))
        .where(F.col("slot") < 24 * 60 // minutes)
    )


def hourly_mean_profile(
    df: DataFrame, t: str, v: str, keys: Keys = SUBJECT, tz_offset: float = 0
) -> DataFrame:
    """24 rows per (key, date): the mean of each hour, NULL when it has no sample."""
    local = shift_hours(t, tz_offset)
    hours = [
        F.avg(F.when(F.col("_h") == h, dbl(v))).alias(f"_h{h}") for h in range(24)
    ]
    wide = (
        df.withColumn("_h", F.hour(local))
        .groupBy(*keys, F.to_date(local).alias("date"))
        .agg(*hours)
    )
    return wide.select(*keys, "date", F.posexplode(F.array(*[f"_h{h}" for h in range(24)])).alias("hour", "mean"))


def stage_minutes(df: DataFrame, keys: Keys = (*SUBJECT, "date")) -> DataFrame:
    sums = [
        F.coalesce(F.sum(F.when(F.col("stage") == s, dbl("seconds") / 60.0)), F.lit(0.0)).alias(f"{s}_min")
        for s in STAGES
    ]
    return df.groupBy(*keys).agg(*sums)


def hr_zone_minutes(
    df: DataFrame, bpm: str = "bpm", birth_date: str | None = None, keys: Keys = SUBJECT
) -> DataFrame:
    """Minutes per heart-rate zone; ``df`` holds one row per minute with its local ``date``."""
    age = age_at(birth_date, "date") if birth_date else F.lit(None).cast("int")
    top = F.coalesce(220 - age, F.lit(190)).cast("double")
    fat, cardio, peak = (F.bround(top * x, 0) for x in (0.4, 0.6, 0.75))
    b = F.col(bpm)
    return df.groupBy(*keys, "date").agg(
        F.count_if(b < fat).alias("zone_out_min"),
        F.count_if((b >= fat) & (b < cardio)).alias("zone_fat_min"),
        F.count_if((b >= cardio) & (b < peak)).alias("zone_cardio_min"),
        F.count_if(b >= peak).alias("zone_peak_min"),
    )


def condition_summary(
    df: DataFrame, cols: Sequence[str], start=None, end=None, t: str = "logged_at", keys: Keys = SUBJECT
) -> DataFrame:
    if start is not None and end is not None:
        df = df.where(F.col(t).between(F.lit(start), F.lit(end)))
    aggs = [F.count("*").alias("total_count")]
    for c in cols:
        aggs += [
            F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}_avg"),
            F.coalesce(F.min(c), F.lit(0)).alias(f"{c}_min"),
            F.coalesce(F.max(c), F.lit(0)).alias(f"{c}_max"),
        ]
    return df.groupBy(*keys).agg(*aggs)


def tag_counts(df: DataFrame, tags: str = "tags", keys: Keys = ()) -> DataFrame:
    exploded = df.select(*keys, F.explode(tags).alias("tag"))
    return exploded.groupBy(*keys, "tag").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "tag")


def count_valid_days(
    quality: DataFrame, days: int = 60, keys: Keys = SUBJECT, out: str = "valid_days"
) -> DataFrame:
    """Days known to be valid in the trailing window, today excluded."""
    w = calendar_frame(keys, days)
    return quality.withColumn(out, F.count(F.when(F.col("is_valid_day"), 1)).over(w))


def minimum_compliance(
    quality: DataFrame, days: int = 7, min_valid: int = 3, keys: Keys = SUBJECT, out: str = "compliant"
) -> DataFrame:
    counted = count_valid_days(quality, days, keys, "_valid")
    return counted.withColumn(out, F.col("_valid") >= min_valid).drop("_valid")


def filtered_aggregate(
    df: DataFrame, pred: Column, cols: Sequence[str], keys: Keys = SUBJECT
) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_if(pred).alias("n_match"),
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{c}") for c in cols],
    )


def median_mad(df: DataFrame, v: str, min_count: int = 7, keys: Keys = SUBJECT) -> DataFrame:
    """Exact median and MAD per key, NULL below ``min_count`` values. Keys of any size: both
    passes rank only a bracket around the median."""
    med = exact_quantiles(df, [v], [0.5], keys).select(*keys, F.col("value").alias("_m"), F.col("n").alias("count"))
    dev = attach(df.select(*keys, v), med, keys).select(
        *keys, F.abs(dbl(v) - F.col("_m")).alias("deviation")
    )
    mad = quantiles_wide(dev, ["deviation"], {"mad": 0.5}, keys)
    both = attach(med, mad, keys)
    enough = F.col("count") >= min_count
    return both.select(
        *keys,
        F.when(enough, F.col("_m")).alias("median"),
        F.when(enough, F.col("deviation_mad")).alias("mad"),
        "count",
    )


def baseline_medians(df: DataFrame, cols: Sequence[str], days: int = 60, keys: Keys = SUBJECT) -> DataFrame:
    """Medians over [d - days, d], today included."""
    w = calendar_frame(keys, days, include_today=True)
    return df.withColumns({f"median_{c}": F.percentile(dbl(c), F.lit(0.5)).over(w) for c in cols})


def weekly_avg(
    df: DataFrame,
    cols: Sequence[str],
    sleep: str = "sleep_duration_min",
    keys: Keys = SUBJECT,
    days: int = 7,
    digits: int | None = 2,
) -> DataFrame:
    """Trailing-week means, rounded half-even; sleep is in hours and skips zeros."""
    w = calendar_frame(keys, days - 1, include_today=True)
    made = {}
    for c in cols:
        value = F.nullif(dbl(c), F.lit(0.0)) / 60.0 if c == sleep else dbl(c)
        name = "avg_sleep_hours" if c == sleep else f"avg_{c}"
        mean = F.avg(value).over(w)
        made[name] = mean if digits is None else F.bround(mean, digits)
    return df.withColumns({"week_days": F.count(F.lit(1)).over(w), **made})


def who5_score(df: DataFrame) -> DataFrame:
    raw = F.col("item1") + F.col("item2") + F.col("item3") + F.col("item4") + F.col("item5")
    return df.withColumns({"raw_score": raw, "percentage": raw * 4})


def session_metrics(
    stages: DataFrame,
    session_id: str = "session_no",
    keys: Keys = SUBJECT,
    attribute_to: str = "end",
    tz_offset: float = 0,
    tie: str = "seconds",
) -> DataFrame:
    """Per session: bounds, minutes per stage (floored per row), onset latency and type.

    ``inbed`` rows count for the bounds only; a session ends with its last row by start.
    """
    sec = F.col("seconds")
    stage = F.col("stage")
    row_end = F.timestamp_micros(epoch_us("time") + sec.cast("long") * 1_000_000)
    minutes = F.floor(sec / 60).cast("long")
    is_asleep = stage.isin(*SLEEP_STAGES)
    of = lambda cond: F.coalesce(F.sum(F.when(cond, minutes)), F.lit(0))
    out = stages.groupBy(*keys, session_id).agg(
        F.min("time").alias("start"),
        F.max_by(row_end, F.struct(F.col("time"), F.col(tie))).alias("end"),
        of(is_asleep).alias("minutes_asleep"),
        *[of(stage == s).alias(f"{s}_min") for s in STAGES],
        F.min(F.when(is_asleep, F.col("time"))).alias("_onset"),
        F.bool_or(stage.isin("deep", "rem")).alias("_staged"),
        F.count_if(stage != "inbed").alias("_rows"),
    )
    between = lambda a, b: F.bround((epoch_us(b) - epoch_us(a)) / 60_000_000.0, 0).cast("long")
    at = F.col("end") if attribute_to == "end" else F.col("start")
    return out.where(F.col("_rows") > 0).select(
        *keys,
        session_id,
        local_date(at, tz_offset).alias("date"),
        "start",
        "end",
        between("start", "end").alias("duration_min"),
        "minutes_asleep",
        F.col("wake_min").alias("minutes_awake"),
        *[f"{s}_min" for s in STAGES],
        F.coalesce(F.greatest(F.lit(0), between("start", "_onset")), F.lit(0)).alias("onset_latency"),
        F.when(F.col("_staged"), "stages").otherwise("classic").alias("sleep_type"),
    )


def session_stage_totals(
    stages: DataFrame, sessions: DataFrame, keys: Keys = SUBJECT, session_id: str = "row_id"
) -> DataFrame:
    """Stage-code milliseconds of the chosen sessions as minutes. Minutes are floored per
    code (two codes are light), asleep and awake totals once over all codes."""
    per_code = stages.groupBy(*keys, session_id, "stage_code").agg(F.sum("duration_ms").alias("_ms"))
    named = per_code.withColumn("_stage", map_stage_code("stage_code")).join(
        sessions.select(*keys, session_id), [*keys, session_id], "left_semi"
    )
    minutes = F.floor(F.col("_ms") / 60000).cast("long")
    of = lambda s: F.coalesce(F.sum(F.when(F.col("_stage") == s, minutes)), F.lit(0)).alias(f"{s}_min")
    total = lambda cond: F.coalesce(F.floor(F.sum(F.when(cond, F.col("_ms"))) / 60000).cast("long"), F.lit(0))
    return named.groupBy(*keys, session_id).agg(
        *[of(s) for s in STAGES],
        total(F.col("_stage").isin(*SLEEP_STAGES)).alias("minutes_asleep"),
        total(F.col("_stage") == "wake").alias("minutes_awake"),
    )


def first_date(df: DataFrame, end, default_days: int = 180, keys: Keys = ()) -> DataFrame:
    """Earliest date; ``end - default_days`` when there is none."""
    fallback = F.date_sub(F.lit(end).cast("date"), default_days)
    return df.groupBy(*keys).agg(F.coalesce(F.min("date"), fallback).alias("first_date"))


def days_since_last(
    df: DataFrame, t: str, as_of: ColumnOrName, due: int = 14, keys: Keys = SUBJECT
) -> DataFrame:
    """Whole days since the latest row and whether a new one is due."""
    now = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    elapsed = F.floor((epoch_us(now) - epoch_us(F.col("last_at"))) / 86_400_000_000.0).cast("long")
    out = df.groupBy(*keys).agg(F.max(t).alias("last_at")).withColumn("days_since", elapsed)
    return out.withColumn("is_due", F.col("days_since") >= due)


def daily_from_parent_child(
    child: DataFrame,
    parent: DataFrame,
    fk: str,
    pk: str,
    value: str,
    tz_offset: float = 9,
    keys: Keys = SUBJECT,
    start: str = "start_time",
    source: str = "source_id",
) -> DataFrame:
    """AVG and MAX per source and local day of the parent record.

    The child is summed per record before the join, so the join carries one row per record.
    """
    per_record = child.groupBy(F.col(fk).alias(pk)).agg(
        F.sum(dbl(value)).alias("_sum"), F.count(value).alias("_n"), F.max(value).alias("_max")
    )
    return (
        per_record.join(parent, pk)
        .groupBy(*keys, local_date(start, tz_offset).alias("date"), source)
        .agg(
            F.try_divide(F.sum("_sum"), F.sum("_n")).alias(f"avg_{value}"),
            F.max("_max").alias(f"max_{value}"),
        )
    )


def daily_scalar_by_source(
    df: DataFrame,
    value: str,
    agg: str = "sum",
    scale: float = 1.0,
    source: str = "source_id",
    tz_offset: float = 9,
    keys: Keys = SUBJECT,
    t: str = "time",
) -> DataFrame:
    fn = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[agg]
    return df.groupBy(*keys, local_date(t, tz_offset).alias("date"), source).agg(
        (fn(dbl(value)) * F.lit(float(scale))).alias(value)
    )
