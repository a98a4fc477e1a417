"""Tall records and sleep sessions to one wide row per subject and day."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymo.core import SUBJECT, Keys
from kymo.functions.numeric import fraction_to_pct
from kymo.operators.aggregates import hr_zone_minutes
from kymo.operators.intervals import main_session, sample_in_session_join
from kymo.operators.reconcile import pick_best_minutes

P = "HKQuantityTypeIdentifier"


@dataclass(frozen=True)
class Rule:
    """How one record type becomes one daily column."""

    column: str
    agg: str  # sum | float_sum | avg | last
    low: float | None = None
    high: float | None = None
    open_low: bool = False
    digits: int = 0
    positive: bool = False  # NULL unless above zero


# Record type, aggregate, plausible range and rounding.
RULES = {
    f"{P}StepCount": Rule("steps", "sum", 0, 200_000, True, 0, True),
    f"{P}DistanceWalkingRunning": Rule("distance_km", "float_sum", 0, 300, True, 3, True),
    f"{P}ActiveEnergyBurned": Rule("calories_active", "sum", 0, 15_000, True, 0, True),
    f"{P}BasalEnergyBurned": Rule("calories_bmr", "sum", 0, 15_000, True, 0, True),
    f"{P}FlightsClimbed": Rule("floors", "sum", positive=True),
    f"{P}RestingHeartRate": Rule("resting_hr", "last", 30, 100),
    f"{P}HeartRateVariabilitySDNN": Rule("hrv_daily_rmssd", "avg", 5, 300, digits=2),
    f"{P}AppleSleepingWristTemperature": Rule("skin_temp_variation", "last", -5, 5, digits=2),
    f"{P}VO2Max": Rule("vo2_max", "last", digits=1),
}
WHOLE = ("steps", "calories_active", "calories_bmr", "floors", "resting_hr")
HEART_RATE, SPO2, BREATHING = f"{P}HeartRate", f"{P}OxygenSaturation", f"{P}RespiratoryRate"
AVG_HR_RANGE = (25.0, 200.0)


def _plausible(rule: Rule, v: Column) -> Column:
    if rule.low is None:
        return F.lit(True)
    above = v > rule.low if rule.open_low else v >= rule.low
    return above & (v <= rule.high)


def daily_scalars(tall: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    """All summed, averaged and last-value metrics in two map-side aggregations: per source,
    then the best plausible source per type."""
    on = [*keys, "date"]
    v = F.col("numeric_value")
    per_source = (
        tall.where(F.col("type").isin(*RULES) & v.isNotNull())
        .groupBy(*on, "type", "source_rank")
        .agg(F.sum(v).alias("_sum"), F.avg(v).alias("_avg"), F.max_by(v, F.struct(F.col("start"), v)).alias("_last"))
    )
    value = F.lit(None).cast("double")
    ok = F.lit(True)
    for kind, rule in RULES.items():
        x = {"sum": F.bround("_sum", 0), "float_sum": F.col("_sum"), "avg": F.col("_avg"), "last": F.col("_last")}[rule.agg]
        value = F.when(F.col("type") == kind, x).otherwise(value)
    per_source = per_source.withColumn("_v", value)
    for kind, rule in RULES.items():
        ok = F.when(F.col("type") == kind, _plausible(rule, F.col("_v"))).otherwise(ok)
    best = F.max_by("_v", F.struct(ok.cast("int"), F.col("source_rank")))
    picked = per_source.groupBy(*on, "type").agg(best.alias("_v"))
    columns = []
    for kind, rule in RULES.items():
        x = F.max(F.when(F.col("type") == kind, F.col("_v")))
        x = F.bround(F.when(x > 0, x) if rule.positive else x, rule.digits)
        columns.append((x.cast("int") if rule.column in WHOLE else x).alias(rule.column))
    return picked.groupBy(*on).agg(*columns)


def daily_rollup(
    tall: DataFrame,
    sessions: DataFrame,
    profile: DataFrame | None = None,
    keys: Keys = SUBJECT,
    tz_offset: float = 0,
) -> DataFrame:
    """One row per (keys, date).

    ``tall``: type, source_rank, start, numeric_value, date (local). ``sessions``: the output of
    ``session_metrics``. ``profile``: birth_date per key, for heart-rate zones.
    """
    on = [*keys, "date"]
    scalars = daily_scalars(tall, keys)

    hr = tall.where(F.col("type") == HEART_RATE)
    minutes = pick_best_minutes(hr, "numeric_value", "start", lambda m: m.between(*AVG_HR_RANGE), keys, tz_offset=tz_offset)
    summary = minutes.groupBy(*on).agg(F.bround(F.avg("bpm"), 1).alias("avg_hr"), F.max("bpm").alias("max_hr"))
    if profile is not None:
        minutes = minutes.join(profile.select(*keys, "birth_date"), list(keys), "left")
    zones = hr_zone_minutes(minutes, "bpm", None if profile is None else "birth_date", keys)

    main = main_session(sessions, keys)
    night = main.select(
        *on,
        F.col("start").alias("sleep_start"),
        F.col("end").alias("sleep_end"),
        F.col("duration_min").alias("sleep_duration_min"),
        F.col("minutes_asleep").alias("sleep_minutes_asleep"),
        F.col("minutes_awake").alias("sleep_minutes_awake"),
        F.col("onset_latency").alias("sleep_onset_latency"),
        "sleep_type",
        *[F.col(f"{s}_min").alias(f"sleep_{s}_min") for s in ("deep", "light", "rem", "wake")],
        F.lit(True).alias("sleep_is_main"),
    )

    samples = tall.where(F.col("type").isin(SPO2, BREATHING) & F.col("numeric_value").isNotNull())
    inside = sample_in_session_join(samples, main, "start", keys)
    pct = F.when(F.col("type") == SPO2, fraction_to_pct("numeric_value"))
    breath = F.when(F.col("type") == BREATHING, F.col("numeric_value"))
    in_sleep = inside.groupBy(*on).agg(
        F.bround(F.avg(pct), 1).alias("spo2_avg"),
        F.bround(F.min(pct), 1).alias("spo2_min"),
        F.bround(F.max(pct), 1).alias("spo2_max"),
        F.bround(F.avg(breath), 1).alias("br_full_sleep"),
    )
    # Every day with a record or a session that ends on it gets a row.
    days = tall.select(*on).distinct().union(sessions.select(*on)).distinct()
    out = days
    for part in (scalars, summary, zones, night, in_sleep):
        out = out.join(part, on, "left")
    total = F.when(
        F.col("calories_active").isNotNull() | F.col("calories_bmr").isNotNull(),
        F.coalesce("calories_active", F.lit(0)) + F.coalesce("calories_bmr", F.lit(0)),
    )
    return out.withColumn("calories_total", total)
