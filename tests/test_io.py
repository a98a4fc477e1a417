"""Sources, sinks and multi-batch streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kymo.operators import scan
from kymo.sources import provider, sinks, tall
from kymo.streaming import runs, streams

D0 = dt.date(2024, 1, 1)
T0 = dt.datetime(2024, 1, 1)


def rows(spark, data):
    return spark.createDataFrame(data, "subject_id int, date date, a int, b int")


def test_three_upsert_rules(spark):
    old = rows(spark, [(1, D0, 5, 6), (2, D0, 7, 8)])
    new = rows(spark, [(1, D0, 0, None), (3, D0, 0, 1)])
    on = ["subject_id", "date"]
    take = lambda df: sorted((r.subject_id, r.a, r.b) for r in df.collect())
    assert take(sinks.upsert_overwrite(old, new, on)) == [(1, 0, None), (2, 7, 8), (3, 0, 1)]
    assert take(sinks.upsert_keep_nonnull(old, new, on)) == [(1, 0, 6), (2, 7, 8), (3, 0, 1)]
    assert take(sinks.upsert_zero_as_null(old, new, on, ["a"])) == [(1, 5, None), (2, 7, 8), (3, 0, 1)]


def test_overwrite_partitions_keeps_the_rest(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.overwrite_partitions(rows(spark, [(1, D0, 1, 1), (1, D0 + dt.timedelta(1), 2, 2)]), path, ["date"])
    sinks.overwrite_partitions(rows(spark, [(1, D0, 9, 9)]), path, ["date"])
    assert sorted(r.a for r in spark.read.parquet(path).collect()) == [2, 9]


def test_xml_export(spark, tmp_path):
    (tmp_path / "export.xml").write_text(
        """<?xml version="1.0"?><HealthData>
 <Me HKCharacteristicTypeIdentifierDateOfBirth="1990-05-10"/>
 <Record type="HKQuantityTypeIdentifierHeartRate" sourceName="My Apple Watch" device="" startDate="2024-01-01 23:30:00 +0900" endDate="2024-01-01 23:30:05 +0900" value="61" unit="count/min"/>
 <Record type="HKQuantityTypeIdentifierHeight" sourceName="x" startDate="2024-01-01 23:30:00 +0900" endDate="2024-01-01 23:30:05 +0900" value="1"/>
 <Record type="HKQuantityTypeIdentifierStepCount" sourceName="x" startDate="bad" endDate="2024-01-01 23:30:05 +0900" value="1"/>
 <Workout workoutActivityType="HKWorkoutActivityTypeRunning" duration="30.5" startDate="2024-01-01 10:00:00 +0900" endDate="2024-01-01 10:30:30 +0900">
  <WorkoutStatistics type="HKQuantityTypeIdentifierDistanceWalkingRunning" sum="5.2"/>
  <WorkoutStatistics type="HKQuantityTypeIdentifierActiveEnergyBurned" sum="310"/>
 </Workout></HealthData>"""
    )
    records, workouts, profile = tall.read_xml_export(spark, str(tmp_path / "export.xml"))
    (r,) = records.collect()
    assert (r.numeric_value, r.source_rank, r.local_date, r.start) == (61.0, 2, D0, dt.datetime(2024, 1, 1, 14, 30))
    (w,) = workouts.collect()
    assert (w.activity_type, w.duration_sec, w.distance_km, w.energy_kcal) == ("Running", 1830.0, 5.2, 310.0)
    assert profile.first().birth_date == dt.date(1990, 5, 10)


def test_tall_reader_fails_on_missing_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1).write.parquet(path)
    with pytest.raises(ValueError, match="missing columns"):
        tall.read_tall_records(spark, path)


def test_provider_sleep_picks_the_main_record(spark):
    body = """{"sleep":[{"logId":1,"isMainSleep":false,"startTime":"2024-01-01T13:00:00.000"},
      {"logId":2,"isMainSleep":true,"startTime":"2024-01-01T23:00:00.000","endTime":"2024-01-02T06:30:00.000","duration":27000000,"minutesAsleep":400,"minutesAwake":50,"type":"classic",
       "levels":{"summary":{"deep":{"minutes":80}},"data":[{"dateTime":"2024-01-01T23:00:00.000","level":"restless","seconds":60},{"dateTime":"oops","level":"asleep","seconds":90}]}}]}"""
    raw = spark.createDataFrame([(1, D0, body), (2, D0, "not json")], "subject_id int, date date, body string")
    (r,) = provider.parse_provider_json(raw, "sleep").collect()
    assert (r.log_id, r.sleep_duration_min, r.sleep_type, r.sleep_deep_min, r.sleep_rem_min) == (2, 450, "classic", 80, 0)
    assert r.sleep_start == dt.datetime(2024, 1, 1, 14)
    got = sorted((x.stage, x.time) for x in provider.parse_provider_stages(raw).collect())
    assert got == [("light", dt.datetime(2024, 1, 1)), ("wake", dt.datetime(2024, 1, 1, 14))]


SCHEMA = "subject_id int, time timestamp, event_id int, value double"


def feed(spark, path, batches):
    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def batches(n=3, size=20):
    return [
        [(s, T0 + dt.timedelta(hours=b * size + i), b * size + i, float((i * 7 + b + s) % 5)) for s in (1, 2) for i in range(size)]
        for b in range(n)
    ]


def test_stream_cusum_goes_on_between_batches(spark, tmp_path):
    data = batches()
    sdf = feed(spark, str(tmp_path / "in"), data)
    out = runs.stream_cusum(sdf, str(tmp_path / "out"), str(tmp_path / "st"), str(tmp_path / "cp"), "value", 1.0, 1.0)
    every = spark.createDataFrame([r for b in data for r in b], SCHEMA)
    want = scan.running_cusum(every, "value", 1.0, 1.0, ["subject_id"], "time", ["event_id"])
    key = lambda r: (r.subject_id, r.event_id)
    got, exp = sorted(out.collect(), key=key), sorted(want.collect(), key=key)
    assert len(got) == 120
    for g, w in zip(got, exp):
        assert key(g) == key(w) and g.cusum_positive == pytest.approx(w.cusum_positive) and g.cusum_alert == w.cusum_alert


def test_last_write_wins_over_batches(spark, tmp_path):
    data = [[(1, T0, 1, 1.0), (2, T0, 2, 2.0)], [(1, T0, 3, 9.0)]]
    sdf = feed(spark, str(tmp_path / "in"), data)
    out = runs.stream_dedup_upsert(sdf, str(tmp_path / "out"), str(tmp_path / "cp"), ["subject_id", "time"], ["event_id"])
    assert sorted((r.subject_id, r.value) for r in out.collect()) == [(1, 9.0), (2, 2.0)]


def test_updates_equal_batch_rollup(spark, tmp_path):
    data = batches()
    sdf = streams.stream_daily_rollup(feed(spark, str(tmp_path / "in"), data), ["value"])
    runs.run_updates(sdf, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = runs.current_rows(runs.read_log(spark, str(tmp_path / "out"), sdf.schema), ["subject_id", "bucket"])
    every = spark.createDataFrame([r for b in data for r in b], SCHEMA)
    want = every.groupBy("subject_id", F.to_date("time").alias("bucket")).agg(F.count("*").alias("n"))
    assert sorted((r.subject_id, r.bucket, r.n) for r in got.collect()) == sorted(map(tuple, want.collect()))
