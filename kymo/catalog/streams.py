"""Queries over streams: the events table is drained as a file stream, and the result is
compared with the batch definition."""

from pyspark.sql import functions as F

from kymo import schemas
from kymo.catalog.composites import ON
from kymo.catalog.registry import cal, query, r, stamp as sql_stamp
from kymo.catalog.show import stamp
from kymo.catalog.sources import landing
from kymo.operators import frames
from kymo.sources.sinks import overwrite_partitions
from kymo.streaming import continuous, runs, sessions, streams, tiers


def _events(v):
    return (
        v.spark.readStream.schema(schemas.EVENTS)
        .option("pathGlobFilter", "events.parquet")
        .parquet(v.sf_dir)
        .select(F.col("user_id").alias("subject_id"), F.col("ts").alias("time"), F.floor(F.col("value") + 50).cast("int").alias("bpm"), "event_id", "event_type", "value")
    )


def _updates(v, sdf, keys):
    out = landing(v, "updates")
    runs.run_updates(sdf, out, landing(v, "state"))
    return runs.current_rows(runs.read_log(v.spark, out, sdf.schema), keys)


def _append(v, sdf):
    out = landing(v, "append")
    runs.run_append(sdf, out, landing(v, "state"))
    return v.spark.read.schema(sdf.schema).parquet(out)


@query(
    "stream_minute_hr",
    f"""SELECT subject_id, {sql_stamp('m')} AS minute, CAST(round_even(avg(CAST(bpm AS DOUBLE)), 0) AS INT) AS bpm FROM (SELECT *, date_trunc('minute', time) AS m FROM heart_rate) x
WHERE m + INTERVAL '1' MINUTE <= (SELECT max(time) - INTERVAL '10' MINUTE FROM heart_rate) GROUP BY subject_id, m""",
)
def _(v):
    """Append mode: minutes the watermark has closed."""
    return _append(v, streams.stream_minute_hr(_events(v))).withColumn("minute", stamp("minute"))


@query(
    "stream_daily_rollup",
    f"SELECT subject_id, CAST(time AS DATE) AS bucket, CAST(count(*) AS BIGINT) AS n, {r('avg(bpm)')} AS bpm_avg FROM heart_rate GROUP BY ALL",
)
def _(v):
    return _updates(v, streams.stream_daily_rollup(_events(v), ["bpm"]), ["subject_id", "bucket"])


@query(
    "stream_hourly_sliding",
    f"""WITH w AS (SELECT subject_id, bpm, date_trunc('hour', time) - INTERVAL '1' HOUR * CAST(unnest(range(10)) AS INT) AS s FROM heart_rate)
SELECT subject_id, {sql_stamp('s')} AS window_start, {r('avg(bpm)')} AS mean, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY subject_id, s""",
)
def _(v):
    out = _updates(v, streams.stream_hourly_sliding(_events(v)), ["subject_id", "window_start"])
    return out.withColumn("window_start", stamp("window_start"))


@query(
    "stream_sleep_sessions",
    f"""WITH s AS (SELECT subject_id, time, seconds, time + to_seconds(seconds + 1800) AS reach FROM sleep_stages),
f AS (SELECT *, CASE WHEN time <= max(reach) OVER (PARTITION BY subject_id ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM s),
n AS (SELECT *, sum(opens) OVER (PARTITION BY subject_id ORDER BY time) AS k FROM f),
g AS (SELECT subject_id, k, min(time) AS a, max(reach) AS b, count(*) AS n, sum(seconds) AS seconds FROM n GROUP BY ALL)
SELECT subject_id, {sql_stamp('a')} AS start, {sql_stamp("b - INTERVAL '30' MINUTE")} AS "end", CAST(n AS BIGINT) AS n_stages, CAST(seconds AS BIGINT) AS seconds FROM g
WHERE b <= (SELECT max(time) - INTERVAL '1' HOUR FROM sleep_stages)""",
)
def _(v):
    """Append mode: sessions the watermark has closed."""
    stages = _events(v).withColumn("seconds", F.floor(F.col("value") * 120).cast("int") + 30)
    out = _append(v, streams.stream_sleep_sessions(stages))
    return out.withColumns({"start": stamp("start"), "end": stamp("end")})


@query(
    "stream_ordered_sessions",
    f"""WITH s AS (SELECT subject_id, time, seconds, event_id, time + to_seconds(seconds) AS stop FROM sleep_stages),
f AS (SELECT *, CASE WHEN time - lag(stop) OVER w <= INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS opens FROM s WINDOW w AS (PARTITION BY subject_id ORDER BY time, event_id)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY subject_id ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM f),
g AS (SELECT subject_id, k, min(time) AS a, arg_max(stop, struct_pack(t := time, e := event_id)) AS b, count(*) AS n, sum(seconds) AS seconds FROM n GROUP BY ALL)
SELECT subject_id, {sql_stamp('a')} AS start, {sql_stamp('b')} AS "end", CAST(n AS BIGINT) AS n_stages, CAST(seconds AS BIGINT) AS seconds FROM g
WHERE b + INTERVAL '30' MINUTE <= (SELECT max(time) - INTERVAL '1' HOUR FROM sleep_stages)""",
)
def _(v):
    """Append mode: sessions of the previous-row rule that the watermark has closed."""
    stages = _events(v).withColumn("seconds", F.floor(F.col("value") * 120).cast("int") + 30)
    with sessions.rocksdb(v.spark):
        out = _append(v, sessions.stream_ordered_sessions(stages))
    return out.withColumns({"start": stamp("start"), "end": stamp("end")})


@query(
    "stream_dedup_upsert",
    "SELECT subject_id, CAST(time AS DATE) AS date, max(event_id) AS event_id, arg_max(bpm, event_id) AS bpm FROM heart_rate GROUP BY subject_id, CAST(time AS DATE)",
)
def _(v):
    sdf = _events(v).select("subject_id", F.to_date("time").alias("date"), "event_id", "bpm")
    return runs.stream_dedup_upsert(sdf, landing(v, "upserts"), landing(v, "state"), ["subject_id", "date"], ["event_id"])


@query(
    "stream_upsert_tiered",
    """SELECT subject_id, CAST(time AS DATE) AS date, arg_max(event_id, struct_pack(b := event_id % 6, e := event_id)) AS event_id,
  arg_max(bpm, struct_pack(b := event_id % 6, e := event_id)) AS bpm FROM heart_rate GROUP BY subject_id, CAST(time AS DATE)""",
)
def _(v):
    """Six batches that land one after the other; the stream stops and goes on after each."""
    rows = v.heart_rate.select("subject_id", F.to_date("time").alias("date"), "event_id", "bpm")
    path, table, state = landing(v, "six"), landing(v, "tiers"), landing(v, "state")
    for batch in range(6):
        rows.where(F.col("event_id") % 6 == batch).write.mode("append").parquet(path)
        sdf = v.spark.readStream.schema(rows.schema).parquet(path)
        out = tiers.stream_upsert_tiered(sdf, table, state, ["subject_id", "date"], ["event_id"])
    return out


_RUN = "OVER (PARTITION BY subject_id ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


_CUSUM = f"""WITH z AS (SELECT user_id AS subject_id, event_id, ts AS time, (value - 50) / 49.0e0 AS z FROM events),
x AS (SELECT *, sum(z - 0.5e0) {_RUN} AS a, sum(-z - 0.5e0) {_RUN} AS b FROM z),
y AS (SELECT *, a - least(0.0e0, min(a) {_RUN}) AS up, b - least(0.0e0, min(b) {_RUN}) AS down FROM x)
SELECT subject_id, event_id, {r('up')} AS cusum_positive, {r('down')} AS cusum_negative, up > 4 OR down > 4 AS cusum_alert FROM y"""
_CHART = ("subject_id", "event_id", "cusum_positive", "cusum_negative", "cusum_alert")


@query("stream_cusum", _CUSUM)
def _(v):
    """The chart without restarts has a closed form, S - min(0, running min of S)."""
    sdf = _events(v).select("subject_id", "time", "event_id", "value")
    out = runs.stream_cusum(sdf, landing(v, "cusum"), landing(v, "cusum-state"), landing(v, "state"), "value", 50.0, 49.0)
    return out.select(*_CHART)


@query("stream_cusum_stateful", _CUSUM)
def _(v):
    return _append(v, streams.stream_cusum_stateful(_events(v), "value", 50.0, 49.0))


def _score(daily):
    return frames.rolling_mean_calendar(daily, ["steps"], 7).select(*ON, "steps_mean_7d")


_SCORES = f"SELECT subject_id, date, avg(steps) {cal(7)} AS x FROM daily"


@query(
    "recompute_open_day",
    f"SELECT subject_id, date, CASE WHEN date >= DATE '2024-01-25' THEN {r('x')} ELSE -1.0e0 END AS steps_mean_7d FROM ({_SCORES}) s",
)
def _(v):
    """Closed days keep what the table holds (here -1); open days are recomputed."""
    table = landing(v, "scores")
    overwrite_partitions(_score(v.daily).withColumn("steps_mean_7d", F.lit(-1.0)), table, ["date"])
    return runs.recompute_open_day(table, _score, v.daily, "2024-01-25", warmup=7)


@query(
    "backfill_range",
    f"SELECT subject_id, date, {r('x')} AS steps_mean_7d FROM ({_SCORES}) s WHERE date BETWEEN DATE '2024-01-12' AND DATE '2024-01-20'",
)
def _(v):
    return runs.backfill_range(_score, v.daily, "2024-01-12", "2024-01-20", landing(v, "backfill"), warmup=7)


@query(
    "continuous_daily_avg",
    f"SELECT subject_id, CAST(time AS DATE) AS bucket, CAST(count(*) AS BIGINT) AS n, {r('avg(bpm)')} AS bpm_avg FROM heart_rate GROUP BY ALL",
)
def _(v):
    """All rows but errors land first and are refreshed; the errors come late and make days stale."""
    hr = v.heart_rate.select("subject_id", "time", "bpm", "source")
    of = continuous.DailyAggregate(landing(v, "continuous"), hr.schema, ("bpm",))
    for batch, part in enumerate((hr.where("source <> 'error'"), hr.where("source = 'error'"))):
        continuous.land(part, of, batch)
        continuous.refresh(v.spark, of)
    return continuous.daily_means(v.spark, of)
