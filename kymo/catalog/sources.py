"""Queries over readers. Landed files are written by Spark from the test tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kymo.catalog.registry import query, r, stamp as sql_stamp
from kymo.catalog.show import stamp
from kymo.operators import aggregates as agg
from kymo.session import shared_dir
from kymo.sources import provider, sinks, tall


def landing(v, name: str) -> str:
    """A new folder on the shared store for one run."""
    return f"{shared_dir(v.spark).rstrip('/')}/kymo-landed/{name}-{uuid.uuid4().hex}"


_TYPE = (
    "CASE event_type WHEN 'click' THEN 'HKQuantityTypeIdentifierHeartRate' WHEN 'view' THEN 'HKQuantityTypeIdentifierStepCount' "
    "WHEN 'error' THEN 'HKQuantityTypeIdentifierVO2Max' WHEN 'signup' THEN 'HKCategoryTypeIdentifierSleepAnalysis' ELSE 'Unlisted' END"
)


def _tall(v):
    """Events as landed text rows; every 11th start is unreadable."""
    local = F.date_format(F.col("ts") + F.expr("INTERVAL '9' HOUR"), "yyyy-MM-dd HH:mm:ss")
    text = F.concat(local, F.lit(" +0900"))
    return v.events.select(
        F.col("user_id").alias("subject_id"),
        F.expr(_TYPE).alias("type"),
        F.expr("CASE event_id % 3 WHEN 0 THEN 'Apple Watch' WHEN 1 THEN 'iPhone' ELSE 'Scale' END").alias("source_name"),
        F.col("event_id").cast("string").alias("device"),
        F.when(F.col("event_id") % 11 == 0, "not a time").otherwise(text).alias("start"),
        text.alias("end"),
        F.col("value").cast("string").alias("value"),
        F.lit("count").alias("unit"),
    )


_TALL_CHECK = f"""SELECT CAST(event_id AS VARCHAR) AS device, {_TYPE} AS type, {sql_stamp('ts')} AS start_at, CAST(ts + INTERVAL '9' HOUR AS DATE) AS local_date,
  {r('value')} AS numeric_value, CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS source_rank
FROM events WHERE event_type <> 'purchase' AND event_id % 11 <> 0"""


def _shown(df):
    return df.select("device", "type", stamp("start").alias("start_at"), "local_date", "numeric_value", "source_rank")


@query("read_tall_records", _TALL_CHECK)
def _(v):
    path = landing(v, "tall")
    _tall(v).write.parquet(path)
    return _shown(tall.read_tall_records(v.spark, path))


@query("read_tall_records_csv", _TALL_CHECK)
def _(v):
    path = landing(v, "tall-csv")
    _tall(v).write.option("header", True).csv(path)
    return _shown(tall.read_tall_records(v.spark, path, fmt="csv"))


@query("read_tall_records_json", _TALL_CHECK)
def _(v):
    path = landing(v, "tall-json")
    _tall(v).write.json(path)
    return _shown(tall.read_tall_records(v.spark, path, fmt="json"))


@query("read_xml_export", _TALL_CHECK)
def _(v):
    path = landing(v, "xml")
    t = _tall(v)
    t.select(
        F.col("type").alias("_type"), F.col("source_name").alias("_sourceName"), F.col("device").alias("_device"),
        F.col("start").alias("_startDate"), F.col("end").alias("_endDate"), F.col("value").alias("_value"), F.col("unit").alias("_unit"),
    ).write.format("xml").option("rootTag", "HealthData").option("rowTag", "Record").save(path)
    records, _workouts, _profile = tall.read_xml_export(v.spark, path)
    return _shown(records)


_WORKOUT_END = "o_orderdate + to_minutes(CAST(o_orderkey % 90 AS BIGINT))"


@query(
    "read_xml_workouts",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS device, replace(o_orderpriority, ' ', '') AS activity_type, o_orderstatus AS source_name,
  {sql_stamp('o_orderdate')} AS start_at, {sql_stamp(_WORKOUT_END)} AS end_at,
  {r('CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 7 = 0 THEN o_orderkey % 90 * 60 ELSE o_totalprice * 60 END')} AS duration_sec,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS distance_km, {r('o_totalprice')} AS energy_kcal FROM orders WHERE o_orderkey % 11 <> 0""",
)
def _(v):
    """Orders as workouts: no duration (read as 0), an unreadable one (end less start), an unreadable
    start (no row), a distance that is listed twice (the last readable sum counts)."""
    path = landing(v, "xml-workouts")
    key = F.col("o_orderkey")
    text = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000"))
    part = lambda kind, total: F.struct(F.lit(f"HKQuantityTypeIdentifier{kind}").alias("_type"), total.cast("string").alias("_sum"))
    known = F.when(key % 3 != 0, F.col("o_custkey").cast("string")).otherwise("unknown")
    v.orders.select(
        F.concat(F.lit("HKWorkoutActivityType"), F.replace("o_orderpriority", F.lit(" "), F.lit(""))).alias("_workoutActivityType"),
        F.col("o_orderstatus").alias("_sourceName"),
        key.cast("string").alias("_device"),
        F.when(key % 11 == 0, "not a time").otherwise(text(F.col("o_orderdate"))).alias("_startDate"),
        text(F.expr("timestampadd(MINUTE, CAST(o_orderkey % 90 AS INT), o_orderdate)")).alias("_endDate"),
        F.when(key % 5 == 0, None).when(key % 7 == 0, "long").otherwise(F.col("o_totalprice").cast("string")).alias("_duration"),
        F.array(
            part("DistanceWalkingRunning", F.when(key % 3 != 0, F.lit("1.5")).otherwise("none")), part("ActiveEnergyBurned", F.col("o_totalprice")),
            part("DistanceWalkingRunning", known),
        ).alias("WorkoutStatistics"),
    ).write.format("xml").option("rootTag", "HealthData").option("rowTag", "Workout").save(path)
    _records, workouts, _profile = tall.read_xml_export(v.spark, path)
    return workouts.select(
        "device", "activity_type", "source_name", stamp("start").alias("start_at"), stamp("end").alias("end_at"), "duration_sec", "distance_km",
        "energy_kcal",
    )


@query(
    "read_xml_profile",
    """SELECT CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS birth_date, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL""",
)
def _(v):
    path = landing(v, "xml-profile")
    born = F.when(F.col("o_orderkey") % 4 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    v.orders.select(born.alias("_HKCharacteristicTypeIdentifierDateOfBirth")).write.format("xml").option("rootTag", "HealthData").option(
        "rowTag", "Me"
    ).save(path)
    _records, _workouts, profile = tall.read_xml_export(v.spark, path)
    return profile.groupBy("birth_date").agg(F.count("*").alias("n"))


def _raw(v, body):
    return v.daily.select("subject_id", "date", F.to_json(body, {"ignoreNullFields": "true"}).alias("body"))


def _struct(**fields):
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _zones():
    zone = lambda name, c: _struct(name=F.lit(name), minutes=F.col(c))
    return F.array(
        zone("Out of Range", "steps"), zone("FAT BURN", "active_zone_min"), zone("Cardio", "sleep_rem_min"), zone("Peak", "resting_hr")
    )


def _endpoints(v):
    summary = _struct(
        steps=F.col("steps"), caloriesOut=F.col("steps"), caloriesBMR=F.col("calories_active"), restingHeartRate=F.col("resting_hr"),
        distances=F.array(_struct(activity=F.lit("tracker"), distance=F.lit(1.5)), _struct(activity=F.lit("total"), distance=F.col("skin_temp_variation"))),
        heartRateZones=_zones(),
    )
    hrv = F.array(_struct(value=_struct(dailyRmssd=F.col("hrv_daily_rmssd"), deepRmssd=F.col("hrv_deep_rmssd"))))
    br = F.array(_struct(value=_struct(fullSleepSummary=_struct(breathingRate=F.col("br_full_sleep")))))
    vo2 = F.concat(F.col("resting_hr").cast("string"), F.lit("-"), (F.col("resting_hr") + 3).cast("string"))
    return {
        "activity": _raw(v, _struct(summary=summary)),
        "hrv": _raw(v, _struct(hrv=hrv)),
        "spo2": _raw(v, _struct(value=_struct(avg=F.col("spo2_avg"), min=F.col("spo2_min")))),
        "breathing_rate": _raw(v, _struct(br=br)),
        "skin_temp": _raw(v, _struct(tempSkin=F.array(_struct(value=_struct(nightlyRelative=F.col("skin_temp_variation")))))),
        "cardio_score": _raw(v, _struct(cardioScore=F.array(_struct(value=_struct(vo2Max=vo2))))),
    }


@query(
    "parse_provider_json",
    f"""SELECT subject_id, date, steps, calories_active AS calories_bmr, CASE WHEN coalesce(steps, 0) > coalesce(calories_active, 0) THEN coalesce(steps, 0) - coalesce(calories_active, 0) ELSE 0 END AS calories_active,
  resting_hr, {r('skin_temp_variation')} AS distance_km, coalesce(resting_hr, 0) AS hr_zone_peak_min, {r('hrv_daily_rmssd')} AS hrv_daily_rmssd, {r('hrv_deep_rmssd')} AS hrv_deep_rmssd,
  {r('spo2_avg')} AS spo2_avg, {r('spo2_min')} AS spo2_min, {r('br_full_sleep')} AS br_full_sleep, {r('skin_temp_variation')} AS skin_temp_variation, {r('resting_hr + 1.5e0')} AS vo2_max FROM daily""",
)
def _(v):
    frames = [provider.parse_provider_json(raw, name) for name, raw in _endpoints(v).items()]
    return provider.merge_daily(frames).select(
        "subject_id", "date", "steps", "calories_bmr", "calories_active", "resting_hr", "distance_km", "hr_zone_peak_min",
        "hrv_daily_rmssd", "hrv_deep_rmssd", "spo2_avg", "spo2_min", "br_full_sleep", "skin_temp_variation", "vo2_max",
    )


@query(
    "zone_minutes_pivot",
    """SELECT subject_id, date, coalesce(steps, 0) AS hr_zone_out_min, coalesce(active_zone_min, 0) AS hr_zone_fat_min,
  coalesce(sleep_rem_min, 0) AS hr_zone_cardio_min, coalesce(resting_hr, 0) AS hr_zone_peak_min FROM daily""",
)
def _(v):
    out = provider.zone_minutes_pivot(v.daily.withColumn("zones", _zones()), "zones")
    return out.select("subject_id", "date", *provider.ZONES.values())


_LOCAL = "ts + INTERVAL '9' HOUR"


def _local():
    return F.expr(_LOCAL)


def _responses(v, body):
    """One response body per event, dated by its local day."""
    return v.events.select(
        F.col("user_id").alias("subject_id"), F.to_date(_local()).alias("date"), F.to_json(body).alias("body")
    )


@query(
    "parse_provider_json_minutes",
    f"SELECT user_id AS subject_id, {sql_stamp('ts')} AS time, CAST(floor(value) AS INT) AS bpm FROM events",
)
def _(v):
    item = _struct(time=F.date_format(_local(), "HH:mm:ss"), value=F.floor("value").cast("int"))
    body = _struct(**{"activities-heart-intraday": _struct(dataset=F.array(item))})
    out = provider.parse_provider_json(_responses(v, body), "heart_intraday")
    return out.select("subject_id", stamp("time").alias("time"), "bpm")


@query(
    "parse_provider_json_stages",
    f"""SELECT user_id AS subject_id, {sql_stamp('ts')} AS time, CASE event_type WHEN 'view' THEN 'deep' WHEN 'click' THEN 'wake' WHEN 'signup' THEN 'light' ELSE event_type END AS stage,
  CAST(floor(value) AS INT) AS seconds FROM events""",
)
def _(v):
    word = F.expr("CASE event_type WHEN 'view' THEN 'Deep' WHEN 'click' THEN 'restless' WHEN 'signup' THEN 'asleep' ELSE event_type END")
    item = _struct(dateTime=F.date_format(_local(), "yyyy-MM-dd'T'HH:mm:ss.SSS"), level=word, seconds=F.floor("value").cast("int"))
    nap = _struct(logId=F.lit(1).cast("long"), isMainSleep=F.lit(False), levels=_struct(data=F.array(item)))
    main = _struct(logId=F.lit(2).cast("long"), isMainSleep=F.lit(True), levels=_struct(data=F.array(item)))
    raw = _responses(v, _struct(sleep=F.array(nap, main)))
    return provider.parse_provider_stages(raw).select("subject_id", stamp("time").alias("time"), "stage", "seconds")


@query(
    "parse_provider_json_exercise",
    f"SELECT user_id AS subject_id, CAST(event_id AS VARCHAR) AS external_id, strftime(ts, '%Y-%m-%d %H:%M:00') AS started_at, event_type AS activity_name, {r('value')} AS distance_km FROM events",
)
def _(v):
    item = _struct(logId=F.col("event_id"), activityName=F.col("event_type"), startTime=F.date_format(_local(), "HH:mm"), distance=F.col("value"))
    out = provider.parse_provider_json(_responses(v, _struct(activities=F.array(item))), "exercise")
    return out.select("subject_id", "external_id", stamp("started_at").alias("started_at"), "activity_name", "distance_km")


@query(
    "daily_from_parent_child",
    f"""SELECT o_custkey AS subject_id, CAST(o_orderdate + INTERVAL '9' HOUR AS DATE) AS date, CASE o_orderstatus WHEN 'F' THEN 3 ELSE 5 END AS source_id,
  {r('avg(l_quantity)')} AS avg_l_quantity, max(l_quantity) AS max_l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def _(v):
    parent = v.orders.select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("subject_id"), F.col("o_orderdate").alias("start_time"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 3 ELSE 5 END").alias("source_id"),
    )
    return agg.daily_from_parent_child(v.lineitem, parent, "l_orderkey", "row_id", "l_quantity")


@query(
    "daily_scalar_by_source",
    f"""WITH s AS (SELECT subject_id, CAST(start + INTERVAL '9' HOUR AS DATE) AS date, source_rank AS source_id, value FROM tall_records)
SELECT subject_id, date, source_id, {r('sum(value) / 1000')} AS km, {r('avg(value)')} AS mean, min(value) AS low, max(value) AS high FROM s GROUP BY subject_id, date, source_id""",
)
def _(v):
    t = v.tall_records.drop("date").withColumnRenamed("source_rank", "source_id")
    on = ["subject_id", "date", "source_id"]
    make = lambda kind, name, scale=1.0: agg.daily_scalar_by_source(t, "value", kind, scale, t="start").withColumnRenamed("value", name)
    out = make("sum", "km", 0.001)
    for kind, name in (("avg", "mean"), ("min", "low"), ("max", "high")):
        out = out.join(make(kind, name), on)
    return out


@query(
    "append_run_log",
    "SELECT user_id AS subject_id, 'anomaly' AS model, 'success' AS status, CAST(count(*) * 2 AS BIGINT) AS training_rows FROM events GROUP BY user_id",
)
def _(v):
    path = landing(v, "runs")
    runs = v.events.groupBy(F.col("user_id").alias("subject_id")).agg(F.count("*").alias("training_rows")).select(
        "subject_id", F.lit("anomaly").alias("model"), F.lit("success").alias("status"), "training_rows"
    )
    sinks.append_run_log(runs, path)
    sinks.append_run_log(runs, path)
    log = v.spark.read.schema(runs.schema).parquet(path)
    return log.groupBy("subject_id", "model", "status").agg(F.sum("training_rows").alias("training_rows"))


@query(
    "parse_provider_sleep",
    f"""SELECT subject_id, date, CAST(coalesce(steps, 0) AS BIGINT) + 1 AS log_id, {sql_stamp('sleep_start')} AS start_at, {sql_stamp('sleep_end')} AS end_at,
  sleep_duration_min, sleep_minutes_asleep, resting_hr AS sleep_minutes_awake, CASE WHEN steps > 5000 THEN 'stages' ELSE 'classic' END AS sleep_type,
  coalesce(sleep_deep_min, 0) AS sleep_deep_min, 0 AS sleep_light_min, coalesce(sleep_rem_min, 0) AS sleep_rem_min, 0 AS sleep_wake_min
FROM daily WHERE sleep_deep_min IS NULL OR sleep_deep_min % 5 <> 0""",
)
def _(v):
    """The daily row of the main sleep; days whose records are all naps give none."""
    local = lambda c: F.date_format(F.col(c) + F.expr("INTERVAL '9' HOUR"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    nap = F.coalesce(F.col("sleep_deep_min") % 5 == 0, F.lit(False))
    minutes = lambda c: _struct(minutes=F.col(c))

    def record(number, is_main):
        return _struct(
            logId=(F.coalesce("steps", F.lit(0)).cast("long") + number), isMainSleep=is_main, startTime=local("sleep_start"), endTime=local("sleep_end"),
            duration=F.col("sleep_duration_min").cast("long") * 60000 + 59999, minutesAsleep=F.col("sleep_minutes_asleep"),
            minutesAwake=F.col("resting_hr"), type=F.when(F.col("steps") > 5000, "stages").otherwise("auto"),
            levels=_struct(summary=_struct(deep=minutes("sleep_deep_min"), rem=minutes("sleep_rem_min"))),
        )

    raw = _raw(v, _struct(sleep=F.array(record(0, F.lit(False)), record(1, ~nap), record(2, ~nap))))
    out = provider.parse_provider_json(raw, "sleep")
    return out.withColumns({"start_at": stamp("sleep_start"), "end_at": stamp("sleep_end")}).drop("sleep_start", "sleep_end")
