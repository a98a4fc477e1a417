"""Queries over aggregates, ranking and paging."""

from pyspark.sql import functions as F

from kymo.catalog.registry import cal, query, r, stamp as sql_stamp
from kymo.catalog.show import stamp
from kymo.functions import circular as circ
from kymo.functions.clock import last_sync
from kymo.operators import aggregates as op
from kymo.operators.intervals import main_log_filter
from kymo.operators import ranking as rank

BIG = "CAST(count(*) AS BIGINT)"


@query(
    "rolling_daily_avg",
    f"""SELECT subject_id, CAST(time AS DATE) AS bucket, {r('avg(bpm)')} AS bpm_avg FROM heart_rate GROUP BY subject_id, CAST(time AS DATE)""",
)
def _(v):
    return op.rolling_daily_avg(v.heart_rate, "time", ["bpm"])


# Samples folded into six-hour steps so that minutes hold several samples.
_COARSE = "date_trunc('day', time) + INTERVAL '1' MINUTE * CAST(floor(extract(HOUR FROM time) / 6) AS INT) + INTERVAL '1' SECOND * CAST(floor(extract(MINUTE FROM time)) AS INT)"


def _coarse(v):
    return v.heart_rate.withColumn("time", F.expr(_COARSE))


@query(
    "minute_resample_mean",
    f"""SELECT subject_id, {sql_stamp("date_trunc('minute', t)")} AS minute, CAST(round_even(avg(CAST(bpm AS DOUBLE)), 0) AS INT) AS bpm
FROM (SELECT *, {_COARSE} AS t FROM heart_rate) x GROUP BY subject_id, date_trunc('minute', t)""",
)
def _(v):
    return op.minute_resample_mean(_coarse(v), "time", "bpm").withColumn("minute", stamp("minute"))


@query(
    "minute_resample_first",
    f"""SELECT subject_id, {sql_stamp('m')} AS minute, bpm, source_rank FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, m ORDER BY source_rank DESC, t, bpm) AS k
FROM (SELECT *, {_COARSE} AS t, date_trunc('minute', {_COARSE}) AS m FROM heart_rate) y) x WHERE k = 1""",
)
def _(v):
    return op.minute_resample_first(_coarse(v), "time", "bpm").withColumn("minute", stamp("minute"))


@query(
    "grid_snap",
    """SELECT subject_id, date, slot, bpm FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, date, slot ORDER BY time DESC, bpm DESC) AS k
FROM (SELECT *, CAST(time AS DATE) AS date, CAST(floor((extract('hour' FROM time) * 60 + extract('minute' FROM time)) / 5.0e0 + 0.5e0) AS INT) AS slot FROM heart_rate) y) x
WHERE k = 1 AND slot < 288""",
)
def _(v):
    return op.grid_snap(v.heart_rate, "time", "bpm")


@query(
    "hourly_mean_profile",
    f"""WITH h AS (SELECT subject_id, CAST(time AS DATE) AS date, CAST(extract('hour' FROM time) AS INT) AS hour, avg(bpm) AS m FROM heart_rate GROUP BY ALL),
d AS (SELECT DISTINCT subject_id, date FROM h), g AS (SELECT d.*, CAST(u.hour AS INT) AS hour FROM d, (SELECT unnest(range(24)) AS hour) u)
SELECT g.subject_id, g.date, g.hour, {r('h.m')} AS mean FROM g LEFT JOIN h USING (subject_id, date, hour)""",
)
def _(v):
    return op.hourly_mean_profile(v.heart_rate, "time", "bpm")


@query(
    "stage_minutes",
    "SELECT subject_id, date, "
    + ", ".join(f"{r(f'''sum(CASE WHEN stage = '{s}' THEN seconds / 60.0e0 ELSE 0 END)''')} AS {s}_min" for s in op.STAGES)
    + " FROM sleep_stages GROUP BY subject_id, date",
)
def _(v):
    return op.stage_minutes(v.sleep_stages)


_BORN = "DATE '1950-03-15' + CAST((subject_id * 997) % 18000 AS INT)"


@query(
    "hr_zone_minutes",
    f"""WITH h AS (SELECT subject_id, CAST(time AS DATE) AS date, bpm, CASE WHEN subject_id % 5 = 0 THEN NULL ELSE {_BORN} END AS born FROM heart_rate),
z AS (SELECT *, CAST(coalesce(220 - date_part('year', age(CAST(date AS TIMESTAMP), CAST(born AS TIMESTAMP))), 190) AS DOUBLE) AS top FROM h)
SELECT subject_id, date,
  CAST(count(*) FILTER (WHERE bpm < round_even(top * 0.4e0, 0)) AS BIGINT) AS zone_out_min,
  CAST(count(*) FILTER (WHERE bpm >= round_even(top * 0.4e0, 0) AND bpm < round_even(top * 0.6e0, 0)) AS BIGINT) AS zone_fat_min,
  CAST(count(*) FILTER (WHERE bpm >= round_even(top * 0.6e0, 0) AND bpm < round_even(top * 0.75e0, 0)) AS BIGINT) AS zone_cardio_min,
  CAST(count(*) FILTER (WHERE bpm >= round_even(top * 0.75e0, 0)) AS BIGINT) AS zone_peak_min
FROM z GROUP BY subject_id, date""",
)
def _(v):
    born = F.when(F.col("subject_id") % 5 != 0, F.expr("date_add(DATE '1950-03-15', CAST((subject_id * 997) % 18000 AS INT))"))
    h = v.heart_rate.withColumns({"date": F.to_date("time"), "born": born})
    return op.hr_zone_minutes(h, "bpm", "born")


_SUMMARY = ["overall", "mental", "overall_vas", "mood_vas"]


@query(
    "condition_summary",
    f"SELECT subject_id, {BIG} AS total_count, "
    + ", ".join(
        f"{r(f'coalesce(avg({c}), 0.0e0)')} AS {c}_avg, coalesce(min({c}), 0) AS {c}_min, coalesce(max({c}), 0) AS {c}_max" for c in _SUMMARY
    )
    + " FROM condition_logs WHERE logged_at BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' GROUP BY subject_id",
)
def _(v):
    return op.condition_summary(v.condition_logs, _SUMMARY, "2024-01-03 00:00:00", "2024-01-20 00:00:00")


@query(
    "tag_counts",
    f"SELECT tag, {BIG} AS count FROM (SELECT unnest(string_split(tags_csv, ',')) AS tag FROM condition_logs) x GROUP BY tag",
)
def _(v):
    return op.tag_counts(v.condition_logs)


@query(
    "count_valid_days",
    f"SELECT subject_id, date, CAST(count(CASE WHEN is_valid_day THEN 1 END) {cal(60)} AS BIGINT) AS valid_days FROM quality",
)
def _(v):
    return op.count_valid_days(v.quality).select("subject_id", "date", "valid_days")


@query(
    "minimum_compliance",
    f"SELECT subject_id, date, count(CASE WHEN is_valid_day THEN 1 END) {cal(7)} >= 3 AS compliant FROM quality",
)
def _(v):
    return op.minimum_compliance(v.quality).select("subject_id", "date", "compliant")


@query(
    "filtered_aggregate",
    f"""SELECT subject_id, CAST(count(*) FILTER (WHERE is_valid_day IS NOT FALSE) AS BIGINT) AS n_match,
  {r('coalesce(avg(completeness_pct), 0.0e0)')} AS avg_completeness_pct FROM quality GROUP BY subject_id""",
)
def _(v):
    valid = F.coalesce(F.col("is_valid_day"), F.lit(True))
    return op.filtered_aggregate(v.quality, valid, ["completeness_pct"])


@query(
    "median_mad",
    f"""SELECT subject_id, CASE WHEN count(value) >= 7 THEN {r('median(value)')} END AS median,
  CASE WHEN count(value) >= 7 THEN {r('mad(value)')} END AS mad, CAST(count(value) AS BIGINT) AS count
FROM (SELECT subject_id, CAST(bpm AS DOUBLE) AS value FROM heart_rate) x GROUP BY subject_id""",
)
def _(v):
    return op.median_mad(v.heart_rate, "bpm")


@query(
    "baseline_medians",
    "SELECT subject_id, date, "
    + ", ".join(f"{r(f'quantile_cont({c}, 0.5) {cal(60, True)}')} AS median_{c}" for c in ("resting_hr", "hrv_daily_rmssd", "sleep_duration_min", "steps", "sleep_deep_min"))
    + " FROM daily",
)
def _(v):
    cols = ["resting_hr", "hrv_daily_rmssd", "sleep_duration_min", "steps", "sleep_deep_min"]
    return op.baseline_medians(v.daily, cols).select("subject_id", "date", *[f"median_{c}" for c in cols])


_TURN = "(2 * pi() / 1440)"


def _minutes(t: str = "time") -> str:
    return f"(extract('hour' FROM {t}) * 60 + extract('minute' FROM {t}) + floor(extract('second' FROM {t})) / 60.0e0)"


def sql_circular(x: str, tail: str = "") -> tuple[str, str]:
    """(mean, deviation) of minutes in the check engine."""
    s, c = f"avg(sin({x} * {_TURN})){tail}", f"avg(cos({x} * {_TURN})){tail}"
    raw = f"atan2({s}, {c}) / {_TURN}"
    mean = f"coalesce(CASE WHEN {raw} < 0 THEN {raw} + 1440 ELSE {raw} END, 0.0e0)"
    big = f"sqrt(({s}) * ({s}) + ({c}) * ({c}))"
    std = f"CASE WHEN count({x}){tail} < 2 THEN 0.0e0 WHEN {big} >= 1 THEN 0.0e0 WHEN {big} <= 0 THEN 720.0e0 ELSE sqrt(-2 * ln({big})) / {_TURN} END"
    return mean, std


@query(
    "circular_mean",
    f"SELECT subject_id, date, {r(sql_circular('m')[0], 4)} AS mean_min FROM (SELECT subject_id, CAST(time AS DATE) AS date, {_minutes()} AS m FROM heart_rate) x GROUP BY subject_id, date",
    digits=4,
)
def _(v):
    from kymo.functions.clock import minute_of_day

    h = v.heart_rate.select("subject_id", F.to_date("time").alias("date"), minute_of_day("time").alias("m"))
    return h.groupBy("subject_id", "date").agg(circ.circular_mean("m").alias("mean_min"))


@query(
    "circular_std",
    f"SELECT subject_id, {r(sql_circular('m')[1], 4)} AS std_min FROM (SELECT subject_id, {_minutes()} AS m FROM heart_rate) x GROUP BY subject_id",
    digits=4,
)
def _(v):
    from kymo.functions.clock import minute_of_day

    h = v.heart_rate.select("subject_id", minute_of_day("time").alias("m"))
    return h.groupBy("subject_id").agg(circ.circular_std("m").alias("std_min"))


_WEEK = ["resting_hr", "hrv_daily_rmssd", "steps", "sleep_deep_min"]


@query(
    "weekly_avg",
    f"SELECT subject_id, date, CAST(count(*) {cal(6, True)} AS BIGINT) AS week_days, "
    + ", ".join(f"{r(f'avg({c}) {cal(6, True)}')} AS avg_{c}" for c in _WEEK)
    + f", {r(f'avg(nullif(CAST(sleep_duration_min AS DOUBLE), 0) / 60.0e0) {cal(6, True)}')} AS avg_sleep_hours FROM daily",
)
def _(v):
    out = op.weekly_avg(v.daily, [*_WEEK, "sleep_duration_min"], digits=None)
    return out.select("subject_id", "date", "week_days", *[f"avg_{c}" for c in _WEEK], "avg_sleep_hours")


@query(
    "who5_score",
    "SELECT id, subject_id, item1 + item2 + item3 + item4 + item5 AS raw_score, (item1 + item2 + item3 + item4 + item5) * 4 AS percentage FROM who5",
)
def _(v):
    return op.who5_score(v.who5).select("id", "subject_id", "raw_score", "percentage")


_CODES = "CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 5 ELSE 6 END"


def _code_min(codes: str) -> str:
    return f"CAST(coalesce(sum(CASE WHEN code IN ({codes}) THEN ms // 60000 END), 0) AS BIGINT)"


def _code_total(codes: str) -> str:
    return f"CAST(coalesce(floor(sum(CASE WHEN code IN ({codes}) THEN ms END) / 60000.0e0), 0) AS BIGINT)"


@query(
    "session_stage_totals",
    f"""WITH s AS (SELECT subject_id, date, log_id, {_CODES} AS code, CAST(seconds AS BIGINT) * 1000 + 7 AS d FROM sleep_stages),
g AS (SELECT subject_id, date, log_id, sum(seconds) AS n FROM sleep_stages GROUP BY ALL),
b AS (SELECT subject_id, date, log_id FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, date ORDER BY n DESC, log_id) AS k FROM g) x WHERE k = 1),
t AS (SELECT subject_id, date, log_id, code, CAST(sum(d) AS BIGINT) AS ms FROM s JOIN b USING (subject_id, date, log_id) GROUP BY ALL)
SELECT subject_id, date, log_id AS row_id, {_code_min('5')} AS deep_min, {_code_min('2, 4')} AS light_min, {_code_min('6')} AS rem_min,
  {_code_min('1')} AS wake_min, {_code_total('2, 4, 5, 6')} AS minutes_asleep, {_code_total('1')} AS minutes_awake
FROM t GROUP BY subject_id, date, log_id""",
)
def _(v):
    s = v.sleep_stages.select(
        "subject_id", "date", F.col("log_id").alias("row_id"), F.expr(_CODES).alias("stage_code"),
        (F.col("seconds").cast("long") * 1000 + 7).alias("duration_ms"),
    )
    main = main_log_filter(v.sleep_stages)
    chosen = main.select("subject_id", "date", F.col("log_id").alias("row_id")).distinct()
    return op.session_stage_totals(s, chosen, ("subject_id", "date"))


@query(
    "first_date",
    "SELECT subject_id, coalesce(min(date), DATE '2024-01-30' - 180) AS first_date FROM daily GROUP BY subject_id",
)
def _(v):
    return op.first_date(v.daily, "2024-01-30", 180, ("subject_id",))


@query(
    "days_since_last",
    f"""SELECT subject_id, {sql_stamp('max(assessed_at)')} AS last_at,
  CAST(floor((epoch_us(TIMESTAMP '2001-09-01 12:00:00') - epoch_us(max(assessed_at))) / 86400000000.0e0) AS BIGINT) AS days_since,
  floor((epoch_us(TIMESTAMP '2001-09-01 12:00:00') - epoch_us(max(assessed_at))) / 86400000000.0e0) >= 60 AS is_due
FROM who5 GROUP BY subject_id""",
)
def _(v):
    return op.days_since_last(v.who5, "assessed_at", "2001-09-01 12:00:00", due=60).withColumn("last_at", stamp("last_at"))


@query("last_sync", f"SELECT subject_id, date, {sql_stamp('greatest(sleep_start, sleep_end)')} AS last_at FROM daily")
def _(v):
    return v.daily.select("subject_id", "date", stamp(last_sync("sleep_start", "sleep_end")).alias("last_at"))


@query(
    "midpoint_mean",
    f"""SELECT subject_id, {r('avg(active_zone_min)')} AS mean_midpoint, {BIG} AS n FROM (SELECT *,
  row_number() OVER (PARTITION BY subject_id ORDER BY date DESC) AS k FROM daily WHERE active_zone_min IS NOT NULL) x WHERE k <= 7 GROUP BY subject_id""",
)
def _(v):
    return rank.midpoint_mean(v.daily, "active_zone_min")


@query("count_over", f"SELECT id, subject_id, CAST(count(*) OVER (PARTITION BY subject_id) AS BIGINT) AS total FROM condition_logs")
def _(v):
    return rank.count_over(v.condition_logs).select("id", "subject_id", "total")


@query(
    "paged_list",
    """SELECT subject_id, id, overall_vas, CAST(row_no AS INT) AS row_no, CAST(total AS BIGINT) AS total FROM (SELECT *,
  row_number() OVER (PARTITION BY subject_id ORDER BY overall_vas DESC, id) AS row_no, count(*) OVER (PARTITION BY subject_id) AS total FROM condition_logs) x
WHERE row_no > 5 AND row_no <= 15""",
)
def _(v):
    return rank.paged_list(v.condition_logs, "overall_vas", "desc", 10, 5).select(
        "subject_id", "id", "overall_vas", "row_no", "total"
    )


@query(
    "latest_row",
    """SELECT subject_id, id, item1, item5 FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY assessed_at DESC, id DESC) AS k FROM who5) x WHERE k = 1""",
)
def _(v):
    return rank.latest_row(v.who5, "assessed_at").select("subject_id", "id", "item1", "item5")


@query(
    "exercise_range",
    f"""SELECT id AS external_id, subject_id, {sql_stamp('assessed_at')} AS started_at FROM who5 WHERE assessed_at BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '1998-06-30 00:00:00'""",
)
def _(v):
    logs = v.who5.select(F.col("id").alias("external_id"), "subject_id", F.col("assessed_at").alias("started_at"))
    out = rank.exercise_range(logs, "1997-01-01 00:00:00", "1998-06-30 00:00:00")
    return out.withColumn("started_at", stamp("started_at"))


_DRIVE = ["resting_hr", "spo2_avg", "br_full_sleep", "skin_temp_variation", "hrv_daily_rmssd", "active_zone_min"]


def _drivers(v):
    items = F.array(
        *[F.struct(F.lit(c).alias("feature"), (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - 40.0).alias("contribution")) for c in _DRIVE]
    )
    return v.daily.withColumn("drivers", items)


def _ranked_sql(limit: str) -> str:
    arms = " UNION ALL ".join(
        f"SELECT subject_id, date, '{c}' AS feature, {i} AS i, coalesce(CAST({c} AS DOUBLE), 0.0e0) - 40.0e0 AS x FROM daily" for i, c in enumerate(_DRIVE)
    )
    return f"""WITH a AS ({arms}), k AS (SELECT *, row_number() OVER (PARTITION BY subject_id, date ORDER BY abs(x) DESC, i) AS n FROM a)
SELECT subject_id, date, string_agg(feature, ',' ORDER BY n) AS features FROM k {limit} GROUP BY subject_id, date"""


@query("top_k_drivers", _ranked_sql("WHERE n <= 3"))
def _(v):
    top = rank.top_k_drivers("drivers", 3)
    return _drivers(v).select("subject_id", "date", F.concat_ws(",", F.transform(top, lambda d: d.feature)).alias("features"))


@query("top_factors_by_importance", _ranked_sql(""))
def _(v):
    top = rank.top_factors_by_importance("drivers", "contribution")
    return _drivers(v).select("subject_id", "date", F.concat_ws(",", F.transform(top, lambda d: d.feature)).alias("features"))


_FOUR = ["resting_hr", "spo2_avg", "br_full_sleep", "skin_temp_variation"]


@query(
    "dominant_driver",
    "WITH a AS ("
    + " UNION ALL ".join(f"SELECT subject_id, date, '{c}' AS feature, {i} AS i, {c} AS x FROM daily" for i, c in enumerate(_FOUR))
    + """), k AS (SELECT *, row_number() OVER (PARTITION BY subject_id, date ORDER BY abs(x) DESC, i) AS n FROM a WHERE x IS NOT NULL AND x <> 0)
SELECT d.subject_id, d.date, k.feature AS driver FROM daily d LEFT JOIN k ON k.subject_id = d.subject_id AND k.date = d.date AND k.n = 1""",
)
def _(v):
    return v.daily.select("subject_id", "date", rank.dominant_driver(_FOUR).alias("driver"))


@query(
    "last_n_with_padding",
    """WITH s AS (SELECT DISTINCT subject_id FROM daily), g AS (SELECT subject_id, DATE '2024-01-31' - CAST(i AS INT) AS date FROM s, (SELECT unnest(range(7)) AS i) u)
SELECT g.subject_id, g.date, d.steps FROM g LEFT JOIN daily d USING (subject_id, date)""",
)
def _(v):
    return rank.last_n_with_padding(v.daily.select("subject_id", "date", "steps"), "2024-01-31")
