"""Landed provider API responses (JSON text) to daily, minute, interval and exercise rows.

``raw`` holds subject_id, date (of the request) and body (JSON text).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymo.core import SUBJECT, Keys, shift_hours
from kymo.functions.numeric import calories_active
from kymo.functions.vocab import map_stage_text, parse_range_midpoint

# The JSON shape of each endpoint.
SHAPES = {
    "activity": """summary STRUCT<steps INT, caloriesOut INT, caloriesBMR INT, floors INT, restingHeartRate INT,
        activeZoneMinutes INT, sedentaryMinutes INT, lightlyActiveMinutes INT, fairlyActiveMinutes INT,
        veryActiveMinutes INT, distances ARRAY<STRUCT<activity STRING, distance DOUBLE>>,
        heartRateZones ARRAY<STRUCT<name STRING, minutes INT>>>""",
    "exercise": """activities ARRAY<STRUCT<logId BIGINT, activityName STRING, startTime STRING, duration BIGINT,
        calories INT, averageHeartRate INT, distance DOUBLE,
        activeZoneMinutes STRUCT<totalMinutes INT, activeZoneMinutes ARRAY<STRUCT<minuteInZone INT, type STRING>>>>>""",
    "sleep": """sleep ARRAY<STRUCT<logId BIGINT, startTime STRING, endTime STRING, duration BIGINT, minutesAsleep INT,
        minutesAwake INT, type STRING, isMainSleep BOOLEAN, levels STRUCT<summary STRUCT<deep STRUCT<minutes INT>,
        light STRUCT<minutes INT>, rem STRUCT<minutes INT>, wake STRUCT<minutes INT>>,
        data ARRAY<STRUCT<dateTime STRING, level STRING, seconds INT>>>>>""",
    "heart_intraday": "`activities-heart-intraday` STRUCT<dataset ARRAY<STRUCT<time STRING, value INT>>>",
    "hrv": "hrv ARRAY<STRUCT<value STRUCT<dailyRmssd DOUBLE, deepRmssd DOUBLE>>>",
    "spo2": "value STRUCT<avg DOUBLE, min DOUBLE, max DOUBLE>",
    "breathing_rate": """br ARRAY<STRUCT<value STRUCT<fullSleepSummary STRUCT<breathingRate DOUBLE>,
        deepSleepSummary STRUCT<breathingRate DOUBLE>, lightSleepSummary STRUCT<breathingRate DOUBLE>,
        remSleepSummary STRUCT<breathingRate DOUBLE>>>>""",
    "skin_temp": "tempSkin ARRAY<STRUCT<value STRUCT<nightlyRelative DOUBLE>>>",
    "cardio_score": "cardioScore ARRAY<STRUCT<value STRUCT<vo2Max STRING>>>",
}
# Heart-rate zone name and its output column.
ZONES = {
    "out of range": "hr_zone_out_min",
    "fat burn": "hr_zone_fat_min",
    "cardio": "hr_zone_cardio_min",
    "peak": "hr_zone_peak_min",
}
LOCAL_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSS"


def zone_minutes(arr: Column, name: str) -> Column:
    """Minutes of the last entry with that name, any case; 0 when it is not there."""
    hits = F.filter(arr, lambda z: F.lower(z["name"]) == name)
    return F.coalesce(F.try_element_at(hits, F.lit(-1))["minutes"], F.lit(0))


def zone_minutes_pivot(df: DataFrame, arr: str, names: dict[str, str] = ZONES) -> DataFrame:
    return df.withColumns({out: zone_minutes(F.col(arr), name) for name, out in names.items()})


def total_distance(arr: Column) -> Column:
    return F.get(F.filter(arr, lambda d: d["activity"] == "total"), F.lit(0))["distance"]


def _utc(local: Column, tz_offset: float) -> Column:
    return shift_hours(local, -tz_offset)


def parse_provider_json(
    raw: DataFrame, endpoint: str, tz_offset: float = 9, keys: Keys = SUBJECT
) -> DataFrame:
    """One endpoint's rows. Malformed bodies give no row. Times in bodies are local."""
    on = [*keys, "date"]
    j = raw.select(*on, F.from_json("body", SHAPES[endpoint]).alias("j")).where(F.col("j").isNotNull())
    if endpoint == "activity":
        s = F.col("j.summary")
        total, bmr = F.coalesce(s["caloriesOut"], F.lit(0)), F.coalesce(s["caloriesBMR"], F.lit(0))
        out = j.where(s.isNotNull()).select(
            *on,
            s["steps"].alias("steps"),
            s["caloriesOut"].alias("calories_total"),
            s["caloriesBMR"].alias("calories_bmr"),
            calories_active(total, bmr).alias("calories_active"),
            s["floors"].alias("floors"),
            s["restingHeartRate"].alias("resting_hr"),
            s["activeZoneMinutes"].alias("active_zone_min"),
            s["sedentaryMinutes"].alias("minutes_sedentary"),
            s["lightlyActiveMinutes"].alias("minutes_lightly"),
            s["fairlyActiveMinutes"].alias("minutes_fairly"),
            s["veryActiveMinutes"].alias("minutes_very"),
            total_distance(s["distances"]).alias("distance_km"),
            s["heartRateZones"].alias("_zones"),
        )
        return zone_minutes_pivot(out, "_zones").drop("_zones")
    if endpoint == "exercise":
        a = j.select(*on, F.explode("j.activities").alias("a"))
        text = F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("T"), F.col("a.startTime"))
        short = _utc(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm")), tz_offset)
        full = F.try_to_timestamp(F.col("a.startTime"), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))
        return a.select(
            *on,
            F.col("a.logId").cast("string").alias("external_id"),
            F.col("a.activityName").alias("activity_name"),
            F.coalesce(short, full, F.col("date").cast("timestamp")).alias("started_at"),
            F.col("a.duration").alias("duration_ms"),
            F.col("a.calories").alias("calories"),
            F.col("a.averageHeartRate").alias("avg_hr"),
            F.col("a.distance").alias("distance_km"),
            F.to_json("a.activeZoneMinutes").alias("zone_minutes"),
        )
    if endpoint == "sleep":
        m = _main_sleep(j, on)
        at = lambda c: _utc(F.try_to_timestamp(F.col(c), F.lit(LOCAL_STAMP)), tz_offset)
        part = lambda p: F.coalesce(F.col(f"m.levels.summary.{p}.minutes"), F.lit(0))
        return m.select(
            *on,
            F.col("m.logId").alias("log_id"),
            at("m.startTime").alias("sleep_start"),
            at("m.endTime").alias("sleep_end"),
            F.floor(F.col("m.duration") / 60000).cast("int").alias("sleep_duration_min"),
            F.col("m.minutesAsleep").alias("sleep_minutes_asleep"),
            F.col("m.minutesAwake").alias("sleep_minutes_awake"),
            F.when(F.col("m.type") == "stages", "stages").otherwise("classic").alias("sleep_type"),
            part("deep").alias("sleep_deep_min"),
            part("light").alias("sleep_light_min"),
            part("rem").alias("sleep_rem_min"),
            part("wake").alias("sleep_wake_min"),
        )
    if endpoint == "heart_intraday":
        d = j.select(*on, F.explode(F.col("j.`activities-heart-intraday`.dataset")).alias("d"))
        text = F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(" "), F.col("d.time"))
        at = _utc(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), tz_offset)
        return d.select(*on, at.alias("time"), F.col("d.value").alias("bpm")).where(F.col("time").isNotNull())
    first = lambda a: F.get(F.col(a), F.lit(0))["value"]
    if endpoint == "hrv":
        x = first("j.hrv")
        cols = {"hrv_daily_rmssd": x["dailyRmssd"], "hrv_deep_rmssd": x["deepRmssd"]}
    elif endpoint == "spo2":
        x = F.col("j.value")
        cols = {"spo2_avg": x["avg"], "spo2_min": x["min"], "spo2_max": x["max"]}
    elif endpoint == "breathing_rate":
        x = first("j.br")
        cols = {
            f"br_{n}_sleep": x[f"{n}SleepSummary"]["breathingRate"] for n in ("full", "deep", "light", "rem")
        }
    elif endpoint == "skin_temp":
        cols = {"skin_temp_variation": first("j.tempSkin")["nightlyRelative"]}
    else:
        cols = {"vo2_max": parse_range_midpoint(first("j.cardioScore")["vo2Max"])}
    return j.select(*on, *[c.alias(n) for n, c in cols.items()])


def _main_sleep(j: DataFrame, on: Sequence[str]) -> DataFrame:
    main = F.get(F.filter("j.sleep", lambda s: s["isMainSleep"]), F.lit(0))
    return j.select(*on, main.alias("m")).where(F.col("m").isNotNull())


def parse_provider_stages(raw: DataFrame, tz_offset: float = 9, keys: Keys = SUBJECT) -> DataFrame:
    """Stage rows of the main sleep; an unreadable time falls back to the request date."""
    on = [*keys, "date"]
    j = raw.select(*on, F.from_json("body", SHAPES["sleep"]).alias("j")).where(F.col("j").isNotNull())
    d = _main_sleep(j, on).select(*on, F.col("m.logId").alias("log_id"), F.explode("m.levels.data").alias("d"))
    at = _utc(F.try_to_timestamp(F.col("d.dateTime"), F.lit(LOCAL_STAMP)), tz_offset)
    return d.select(
        *on,
        F.coalesce(at, F.col("date").cast("timestamp")).alias("time"),
        map_stage_text("d.level", "provider").alias("stage"),
        F.col("d.seconds").alias("seconds"),
        "log_id",
    )


def merge_daily(frames: Sequence[DataFrame], keys: Keys = SUBJECT) -> DataFrame:
    """Outer-join per-endpoint daily frames on (keys, date); all share one partitioning."""
    return reduce(lambda a, b: a.join(b, [*keys, "date"], "full"), frames)
