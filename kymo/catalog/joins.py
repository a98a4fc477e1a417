"""Queries over joins and interval operators."""

from pyspark.sql import functions as F

from kymo.catalog.registry import cal, query, r, stamp as sql_stamp
from kymo.catalog.show import stamp
from kymo.operators import aggregates as agg
from kymo.operators import frames, intervals as iv, joins as op

_END = "time + to_seconds(seconds)"


@query(
    "join_quality_left",
    f"""SELECT d.subject_id, d.date, d.steps, q.is_valid_day, {r('q.completeness_pct')} AS completeness_pct
FROM daily d LEFT JOIN quality q USING (subject_id, date)""",
)
def _(v):
    out = op.join_quality_left(v.daily, v.quality)
    return out.select("subject_id", "date", "steps", "is_valid_day", "completeness_pct")


@query(
    "join_conditions_inner",
    """SELECT c.id, c.subject_id, d.date, c.overall_vas, d.steps, q.is_valid_day
FROM condition_logs c JOIN daily d ON d.subject_id = c.subject_id AND d.date = CAST(c.logged_at AS DATE)
LEFT JOIN quality q ON q.subject_id = d.subject_id AND q.date = d.date WHERE coalesce(q.is_valid_day, TRUE)""",
)
def _(v):
    out = op.join_conditions_inner(v.daily, v.condition_logs, v.quality)
    return out.select("id", "subject_id", "date", "overall_vas", "steps", "is_valid_day")


@query(
    "cross_join_scalar",
    f"""SELECT subject_id, date, {r(f'avg(steps) {cal(7)}')} AS steps_7d, {r(f'stddev_pop(resting_hr) {cal(3)}')} AS rhr_3d_std FROM daily""",
)
def _(v):
    out = frames.cross_join_scalar(
        v.daily, {"steps_7d": ("mean", "steps", 7), "rhr_3d_std": ("std", "resting_hr", 3)}
    )
    return out.select("subject_id", "date", "steps_7d", "rhr_3d_std")


@query(
    "lateral_rolling_median",
    f"""SELECT d.subject_id, d.date, {r('m.x')} AS steps_median_60d
FROM daily d LEFT JOIN LATERAL (SELECT quantile_cont(steps, 0.5) AS x FROM daily e WHERE e.subject_id = d.subject_id
  AND e.date BETWEEN d.date - 60 AND d.date - 1) m ON TRUE""",
)
def _(v):
    out = frames.lateral_rolling_median(v.daily, ["steps"], 60)
    return out.select("subject_id", "date", "steps_median_60d")


@query(
    "prev_day_join",
    """SELECT d.subject_id, d.date, p.resting_hr AS prev_resting_hr, p.steps AS prev_steps
FROM daily d LEFT JOIN daily p ON p.subject_id = d.subject_id AND p.date = d.date - 1""",
)
def _(v):
    out = frames.prev_day_join(v.daily, ["resting_hr", "steps"])
    return out.select("subject_id", "date", "prev_resting_hr", "prev_steps")


@query(
    "today_vs_yesterday",
    f"""SELECT d.subject_id, d.date, d.steps - p.steps AS steps_vs_yesterday,
  {r('d.spo2_avg - p.spo2_avg')} AS spo2_avg_vs_yesterday
FROM daily d LEFT JOIN daily p ON p.subject_id = d.subject_id AND p.date = d.date - 1""",
)
def _(v):
    out = frames.today_vs_yesterday(v.daily, ["steps", "spo2_avg"])
    return out.select("subject_id", "date", "steps_vs_yesterday", "spo2_avg_vs_yesterday")


@query(
    "point_in_interval_join",
    f"""SELECT h.subject_id, h.event_id, h.bpm FROM heart_rate h WHERE EXISTS (SELECT 1 FROM sleep_stages s
  WHERE s.subject_id = h.subject_id AND s.stage IN ('deep', 'light', 'rem')
  AND s.time <= h.time AND h.time < s.{_END.replace('seconds)', 's.seconds)').replace('time +', 'time +')})""",
)
def _(v):
    out = iv.point_in_interval_join(v.heart_rate, iv.asleep(v.sleep_stages))
    return out.select("subject_id", "event_id", "bpm")


@query(
    "sample_in_session_join",
    """SELECT h.subject_id, h.event_id, h.bpm FROM heart_rate h JOIN daily d ON d.subject_id = h.subject_id
  AND d.date = CAST(h.time AS DATE) WHERE h.time BETWEEN d.sleep_start AND d.sleep_end""",
)
def _(v):
    samples = v.heart_rate.withColumn("date", F.to_date("time"))
    sessions = v.daily.select(
        "subject_id", "date", F.col("sleep_start").alias("start"), F.col("sleep_end").alias("end")
    )
    return iv.sample_in_session_join(samples, sessions).select("subject_id", "event_id", "bpm")


@query(
    "best_stages_for_day",
    """WITH d AS (SELECT subject_id, date,
  CASE WHEN sleep_start IS NOT NULL AND sleep_end IS NOT NULL THEN sleep_start ELSE CAST(date AS TIMESTAMP) - INTERVAL '6' HOUR END AS a,
  CASE WHEN sleep_start IS NOT NULL AND sleep_end IS NOT NULL THEN sleep_end ELSE CAST(date AS TIMESTAMP) + INTERVAL '14' HOUR END AS b FROM daily)
SELECT s.subject_id, d.date, s.event_id, s.stage, s.seconds FROM sleep_stages s JOIN d ON d.subject_id = s.subject_id AND s.time >= d.a AND s.time < d.b""",
)
def _(v):
    return iv.best_stages_for_day(v.sleep_stages, v.daily).select(
        "subject_id", "date", "event_id", "stage", "seconds"
    )


@query(
    "proximity_anti_join",
    """SELECT subject_id, event_id FROM sleep_stages a WHERE log_id = 0 AND NOT EXISTS (SELECT 1 FROM sleep_stages b
  WHERE b.subject_id = a.subject_id AND b.log_id <> 0 AND b.time BETWEEN a.time - INTERVAL '2' HOUR AND a.time + INTERVAL '2' HOUR)""",
)
def _(v):
    s = v.sleep_stages
    out = iv.proximity_anti_join(s.where("log_id = 0"), s.where("log_id <> 0"), tolerance_seconds=7200)
    return out.select("subject_id", "event_id")


@query(
    "same_day_anti_join",
    """SELECT subject_id, event_id FROM sleep_stages a WHERE log_id = 0 AND NOT EXISTS (SELECT 1 FROM sleep_stages b
  WHERE b.subject_id = a.subject_id AND b.log_id <> 0 AND date_trunc('day', b.time) = date_trunc('day', a.time))""",
)
def _(v):
    s = v.sleep_stages
    return iv.same_day_anti_join(s.where("log_id = 0"), s.where("log_id <> 0")).select("subject_id", "event_id")


@query(
    "skip_if_existing",
    f"""WITH n AS (SELECT *, {_END} AS stop FROM sleep_stages WHERE log_id = 0),
g AS (SELECT subject_id, date, min(time) AS a, arg_max(stop, time) AS b FROM n GROUP BY subject_id, date)
SELECT n.subject_id, n.event_id FROM n JOIN g USING (subject_id, date) WHERE NOT EXISTS (SELECT 1 FROM sleep_stages o
  WHERE o.subject_id = n.subject_id AND o.log_id = 1 AND o.time >= g.a AND o.time < g.b)""",
)
def _(v):
    s = v.sleep_stages
    out = iv.skip_if_existing(s.where("log_id = 0"), s.where("log_id <> 0"), F.col("log_id") == 1)
    return out.select("subject_id", "event_id")


@query(
    "latest_log_per_day",
    """SELECT subject_id, date, id, overall_vas FROM (SELECT subject_id, CAST(logged_at AS DATE) AS date, id, overall_vas,
  row_number() OVER (PARTITION BY subject_id, CAST(logged_at AS DATE) ORDER BY logged_at DESC, id DESC) AS n FROM condition_logs) x WHERE n = 1""",
)
def _(v):
    return op.latest_log_per_day(v.condition_logs).select("subject_id", "date", "id", "overall_vas")


@query(
    "count_pairs",
    """SELECT c.subject_id, CAST(count(*) AS BIGINT) AS pairs FROM condition_logs c
JOIN daily d ON d.subject_id = c.subject_id AND d.date = CAST(c.logged_at AS DATE)
LEFT JOIN quality q ON q.subject_id = d.subject_id AND q.date = d.date WHERE q.is_valid_day IS NOT FALSE GROUP BY c.subject_id""",
)
def _(v):
    return op.count_pairs(v.condition_logs, v.daily, v.quality)


@query(
    "daily_context",
    f"""SELECT d.subject_id, d.date, d.resting_hr, d.steps, {r('q.completeness_pct')} AS completeness_pct,
  c.overall_vas, {r('b.median_steps')} AS median_steps, {r('w.avg_steps')} AS avg_steps
FROM daily d LEFT JOIN quality q USING (subject_id, date)
LEFT JOIN (SELECT subject_id, CAST(logged_at AS DATE) AS date, arg_max(overall_vas, logged_at) AS overall_vas
  FROM condition_logs GROUP BY subject_id, CAST(logged_at AS DATE)) c USING (subject_id, date)
LEFT JOIN (SELECT subject_id, date, quantile_cont(steps, 0.5) {cal(60, True)} AS median_steps FROM daily) b USING (subject_id, date)
LEFT JOIN (SELECT subject_id, date, avg(steps) {cal(6, True)} AS avg_steps FROM daily) w USING (subject_id, date)""",
)
def _(v):
    tables = {
        "quality": v.quality,
        "condition": op.latest_log_per_day(v.condition_logs).select("subject_id", "date", "overall_vas", "tags"),
        "baselines": agg.baseline_medians(v.daily, ["steps"]).select("subject_id", "date", "median_steps"),
        "week": agg.weekly_avg(v.daily, ["steps"], digits=None).select("subject_id", "date", "avg_steps"),
    }
    out = op.daily_context(v.daily, tables)
    return out.select(
        "subject_id", "date", "biometrics.resting_hr", "biometrics.steps", "quality.completeness_pct",
        "condition.overall_vas", "baselines.median_steps", "week.avg_steps",
    )


_SPANS = f"SELECT *, {_END} AS stop FROM sleep_stages"


@query(
    "gap_sessionize",
    f"""WITH s AS ({_SPANS}), f AS (SELECT *, CASE WHEN time - lag(stop) OVER (PARTITION BY subject_id ORDER BY time) <= INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS opens FROM s)
SELECT subject_id, event_id, CAST(sum(opens) OVER (PARTITION BY subject_id ORDER BY time) AS BIGINT) AS session_no FROM f""",
)
def _(v):
    s = v.sleep_stages.withColumn("end", F.expr("timestampadd(SECOND, seconds, time)"))
    return iv.gap_sessionize(s, "time", "end").select("subject_id", "event_id", "session_no")


_SESSIONS = f"""s AS ({_SPANS}), f AS (SELECT *, CASE WHEN time - lag(stop) OVER (PARTITION BY subject_id ORDER BY time) <= INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS opens FROM s),
n AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY subject_id ORDER BY time) AS BIGINT) AS session_no FROM f),
m AS (SELECT subject_id, session_no, min(time) AS a, arg_max(stop, time) AS b,
  CAST(sum(CASE WHEN stage IN ('deep', 'light', 'rem') THEN seconds // 60 ELSE 0 END) AS BIGINT) AS minutes_asleep,
  CAST(sum(CASE WHEN stage = 'wake' THEN seconds // 60 ELSE 0 END) AS BIGINT) AS minutes_awake,
  CAST(sum(CASE WHEN stage = 'deep' THEN seconds // 60 ELSE 0 END) AS BIGINT) AS deep_min,
  CAST(sum(CASE WHEN stage = 'light' THEN seconds // 60 ELSE 0 END) AS BIGINT) AS light_min,
  CAST(sum(CASE WHEN stage = 'rem' THEN seconds // 60 ELSE 0 END) AS BIGINT) AS rem_min,
  min(CASE WHEN stage IN ('deep', 'light', 'rem') THEN time END) AS onset, bool_or(stage IN ('deep', 'rem')) AS staged
  FROM n GROUP BY subject_id, session_no),
sess AS (SELECT subject_id, session_no, CAST(b AS DATE) AS date, a, b,
  CAST(round_even((epoch_us(b) - epoch_us(a)) / 60000000.0e0, 0) AS BIGINT) AS duration_min, minutes_asleep, minutes_awake, deep_min, light_min, rem_min,
  coalesce(greatest(0, CAST(round_even((epoch_us(onset) - epoch_us(a)) / 60000000.0e0, 0) AS BIGINT)), 0) AS onset_latency,
  CASE WHEN staged THEN 'stages' ELSE 'classic' END AS sleep_type FROM m)"""


def _sessions(v):
    s = v.sleep_stages.withColumn("end", F.expr("timestampadd(SECOND, seconds, time)"))
    return agg.session_metrics(iv.gap_sessionize(s, "time", "end"))


@query(
    "session_metrics",
    f"""WITH {_SESSIONS} SELECT subject_id, session_no, date, duration_min, minutes_asleep, minutes_awake, deep_min, light_min,
  rem_min, minutes_awake AS wake_min, onset_latency, sleep_type, {sql_stamp('a')} AS start_at, {sql_stamp('b')} AS end_at FROM sess""",
)
def _(v):
    return _sessions(v).select(
        "subject_id", "session_no", "date", "duration_min", "minutes_asleep", "minutes_awake", "deep_min",
        "light_min", "rem_min", "wake_min", "onset_latency", "sleep_type",
        stamp("start").alias("start_at"), stamp("end").alias("end_at"),
    )


@query(
    "main_session",
    f"""WITH {_SESSIONS} SELECT subject_id, date, session_no, duration_min FROM (SELECT *,
  row_number() OVER (PARTITION BY subject_id, date ORDER BY duration_min DESC, a) AS k FROM sess) x WHERE k = 1""",
)
def _(v):
    return iv.main_session(_sessions(v)).select("subject_id", "date", "session_no", "duration_min")


@query(
    "longest_session_per_source",
    f"""WITH s AS (SELECT subject_id, event_id, date, CASE log_id WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS source_rank, seconds FROM sleep_stages)
SELECT subject_id, date, event_id, source_rank, seconds FROM (SELECT *,
  row_number() OVER (PARTITION BY subject_id, date ORDER BY source_rank DESC, k, event_id) AS j FROM (SELECT *,
  row_number() OVER (PARTITION BY subject_id, date, source_rank ORDER BY seconds DESC, event_id) AS k FROM s) y WHERE k = 1) x WHERE j = 1""",
)
def _(v):
    s = v.sleep_stages.select(
        "subject_id", "date", "event_id", "seconds", F.col("time").alias("start"),
        F.expr("timestampadd(SECOND, seconds, time)").alias("end"),
        F.expr("CASE log_id WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END").alias("source_rank"),
    )
    out = iv.longest_session_per_source(s, tie="event_id")
    return out.select("subject_id", "date", "event_id", "source_rank", "seconds")


@query(
    "short_wake_flag",
    "SELECT event_id, stage, (stage = 'wake' AND seconds < 180) AS is_short FROM sleep_stages",
)
def _(v):
    return iv.short_wake_flag(v.sleep_stages).select("event_id", "stage", "is_short")


@query(
    "main_log_filter",
    """WITH t AS (SELECT subject_id, date, log_id, sum(seconds) AS n FROM sleep_stages GROUP BY subject_id, date, log_id),
b AS (SELECT subject_id, date, log_id FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, date ORDER BY n DESC, log_id) AS k FROM t) x WHERE k = 1)
SELECT s.subject_id, s.date, s.log_id, s.event_id FROM sleep_stages s JOIN b USING (subject_id, date, log_id)""",
)
def _(v):
    return iv.main_log_filter(v.sleep_stages).select("subject_id", "date", "log_id", "event_id")


@query(
    "overlap_chain_dedup",
    f"""WITH RECURSIVE s AS (SELECT *, {_END} AS stop, row_number() OVER (PARTITION BY subject_id, date ORDER BY time) AS n FROM sleep_stages),
walk AS (SELECT subject_id, date, n, event_id, stop AS reach, TRUE AS kept FROM s WHERE n = 1
  UNION ALL SELECT s.subject_id, s.date, s.n, s.event_id, CASE WHEN s.time >= w.reach THEN s.stop ELSE w.reach END, s.time >= w.reach
  FROM walk w JOIN s ON s.subject_id = w.subject_id AND s.date = w.date AND s.n = w.n + 1)
SELECT subject_id, date, event_id FROM walk WHERE kept""",
)
def _(v):
    return iv.overlap_chain_dedup(v.sleep_stages).select("subject_id", "date", "event_id")


# Lines of an order as a chain of stages: 100 s apart, and a returned line is 50 s short.
_LINKS = """SELECT l_orderkey AS log_id, l_linenumber, TIMESTAMP '2024-01-01 00:00:00' + l_linenumber * INTERVAL '100' SECOND AS time,
  CASE WHEN min(l_returnflag) = 'R' THEN 50 ELSE 100 END AS seconds FROM lineitem GROUP BY l_orderkey, l_linenumber"""


@query(
    "chain_trace",
    f"""WITH RECURSIVE s AS ({_LINKS}), f AS (SELECT log_id, min(time) AS time FROM s GROUP BY log_id),
walk AS (SELECT s.log_id, s.l_linenumber, s.time + to_seconds(s.seconds) AS stop FROM s JOIN f USING (log_id, time)
  UNION ALL SELECT s.log_id, s.l_linenumber, s.time + to_seconds(s.seconds) FROM walk w JOIN s ON s.log_id = w.log_id AND s.time = w.stop)
SELECT log_id, l_linenumber FROM walk""",
)
def _(v):
    s = v.sql(_LINKS)
    return iv.chain_trace(s, keys=()).select("log_id", "l_linenumber")
