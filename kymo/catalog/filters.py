"""Queries over the filter and rule operators."""

from pyspark.sql import functions as F

from kymo.catalog.registry import cal, flags, query, r, stamp as sql_stamp
from kymo.catalog.show import joined, stamp
from kymo.core import calendar_frame
from kymo.functions.clock import effective_date
from kymo.functions.numeric import safe_ln
from kymo.operators import filters as op


@query("get_by_date", "SELECT subject_id, date, steps, resting_hr FROM daily WHERE date = DATE '2024-01-10'")
def _(v):
    return op.get_by_date(v.daily, "2024-01-10").select("subject_id", "date", "steps", "resting_hr")


@query(
    "list_range",
    "SELECT subject_id, date, steps FROM daily WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' ORDER BY date",
)
def _(v):
    return op.list_range(v.daily, "2024-01-05", "2024-01-20").select("subject_id", "date", "steps")


@query(
    "time_range_half_open",
    "SELECT subject_id, event_id, stage, seconds FROM sleep_stages WHERE time >= TIMESTAMP '2024-01-03 00:00:00' AND time < TIMESTAMP '2024-01-12 00:00:00'",
)
def _(v):
    out = op.time_range_half_open(
        v.sleep_stages, "time", "2024-01-03 00:00:00", "2024-01-12 00:00:00"
    )
    return out.select("subject_id", "event_id", "stage", "seconds")


@query(
    "time_range_closed",
    "SELECT subject_id, event_id, bpm FROM heart_rate WHERE time BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'",
)
def _(v):
    out = op.time_range_closed(v.heart_rate, "time", "2024-01-03 00:00:00", "2024-01-12 00:00:00")
    return out.select("subject_id", "event_id", "bpm")


@query(
    "valid_day_filter",
    "SELECT d.subject_id, d.date, d.steps FROM daily d LEFT JOIN quality q USING (subject_id, date) WHERE coalesce(q.is_valid_day, TRUE)",
)
def _(v):
    return op.valid_day_filter(v.daily, v.quality).select("subject_id", "date", "steps")


def _status(column: str, low: float, high: float) -> str:
    missing = f"{column} IS NULL" + (f" OR {column} = 0" if column == "resting_hr" else "")
    return (
        f"CASE WHEN {missing} THEN 'missing' WHEN {column} < {low} THEN 'fail_low' "
        f"WHEN {column} > {high} THEN 'fail_high' ELSE 'pass' END"
    )


@query(
    "plausibility_flags",
    "SELECT subject_id, date, "
    + ", ".join(f"{_status(c, lo, hi)} AS flag_{n}" for n, (c, lo, hi) in op.PLAUSIBLE.items())
    + " FROM daily",
)
def _(v):
    f = op.plausibility_flags(v.daily)
    return f.select("subject_id", "date", *[F.col("plausibility_flags")[n].alias(f"flag_{n}") for n in op.PLAUSIBLE])


def _present(column: str) -> str:
    zero = f" AND {column} <> 0" if column in op.ZERO_IS_ABSENT else ""
    return f"({column} IS NOT NULL{zero})"


@query(
    "metric_completeness",
    f"""SELECT subject_id, date,
  {flags(*[(n, _present(c)) for n, c in op.COMPLETENESS.items()])} AS present,
  {flags(*[(n, f'NOT {_present(c)}') for n, c in op.COMPLETENESS.items()])} AS missing,
  {r('(' + ' + '.join(f'CASE WHEN {_present(c)} THEN 1 ELSE 0 END' for c in op.COMPLETENESS.values()) + ') / 7.0e0')} AS pct
FROM daily""",
)
def _(v):
    return op.metric_completeness(v.daily).select(
        "subject_id",
        "date",
        joined("metrics_present").alias("present"),
        joined("metrics_missing").alias("missing"),
        F.col("completeness_pct").alias("pct"),
    )


def _artifact(metric: str, low: float, high: float) -> tuple[str, str]:
    zero = f" AND {metric} <> 0" if metric in op.ZERO_SENTINEL else ""
    return f"out_of_range_{metric}", f"({metric} < {low} OR {metric} > {high}){zero}"


@query(
    "sensor_artifacts",
    f"""WITH f AS (SELECT *, CASE WHEN hrv_daily_rmssd > 0 THEN ln(hrv_daily_rmssd) END AS hrv_ln_rmssd,
  stddev_pop(resting_hr) {cal(3)} AS rhr_3d_std FROM daily)
SELECT subject_id, date, {flags(('flat_line_hr', 'rhr_3d_std < 0.5'), *[_artifact(m, lo, hi) for m, (lo, hi) in op.SENSOR_RANGES.items()])} AS artifacts
FROM f""",
)
def _(v):
    f = v.daily.withColumns(
        {
            "hrv_ln_rmssd": safe_ln("hrv_daily_rmssd"),
            "rhr_3d_std": F.stddev_pop("resting_hr").over(calendar_frame(["subject_id"], 3)),
        }
    )
    return op.sensor_artifacts(f).select("subject_id", "date", joined("artifacts").alias("artifacts"))


@query(
    "validate_condition",
    f"""SELECT id, subject_id, {flags(
        ('overall_vas', 'overall_vas IS NULL OR overall_vas < 0 OR overall_vas > 100'),
        ('mood_vas', 'mood_vas < 0 OR mood_vas > 100'),
        ('overall', 'overall <> 0 AND (overall < 1 OR overall > 5)'),
        ('mental', 'mental < 1 OR mental > 5'),
        ('note', 'octet_length(encode(tags_csv)) > 1000'),
        ('tag_count', "len(string_split(tags_csv, ',')) > 10"),
        ('tag_length', "list_max(list_transform(string_split(tags_csv, ','), lambda x: octet_length(encode(x)))) > 50"),
    )} AS violations FROM condition_logs""",
)
def _(v):
    logs = v.condition_logs.withColumn("note", F.col("tags_csv"))
    return op.validate_condition(logs).select("id", "subject_id", joined("violations").alias("violations"))


@query(
    "validate_who5",
    f"""WITH w AS (SELECT *, CAST(assessed_at AS DATE) AS period_start,
  CAST(assessed_at AS DATE) + (item1 - 1) AS period_end FROM who5)
SELECT id, subject_id, {flags(*[(f'item{i}', f'item{i} IS NULL OR item{i} < 0 OR item{i} > 5') for i in range(1, 6)],
  ('period_start', 'period_start IS NULL'), ('period_end', 'period_end IS NULL'), ('period_order', 'period_end < period_start'))} AS violations
FROM w""",
)
def _(v):
    w = v.who5.withColumn("period_start", F.to_date("assessed_at")).withColumn(
        "period_end", F.date_add("period_start", F.col("item1") - 1)
    )
    return op.validate_who5(w).select("id", "subject_id", joined("violations").alias("violations"))


@query(
    "tag_contains",
    """SELECT id, subject_id, overall_vas FROM condition_logs
WHERE list_contains(string_split(tags_csv, ','), 'g3')
  AND logged_at BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00'""",
)
def _(v):
    out = op.tag_contains(v.condition_logs, "g3", "logged_at", "2024-01-02 00:00:00", "2024-01-25 00:00:00")
    return out.select("id", "subject_id", "overall_vas")


@query(
    "exclude_dates",
    "SELECT subject_id, date, steps FROM daily WHERE date NOT IN (DATE '2024-01-15', DATE '2024-01-16', DATE '2024-01-17')",
)
def _(v):
    return op.exclude_dates(v.daily, ["2024-01-15", "2024-01-16", "2024-01-17"]).select("subject_id", "date", "steps")


@query(
    "iqr_outlier_filter",
    """WITH s AS (SELECT subject_id, quantile_cont(steps, 0.25) AS q1, quantile_cont(steps, 0.75) AS q3 FROM daily GROUP BY subject_id)
SELECT d.subject_id, d.date, d.steps FROM daily d JOIN s USING (subject_id)
WHERE d.steps BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)""",
)
def _(v):
    return op.iqr_outlier_filter(v.daily, "steps", 0.5).select("subject_id", "date", "steps")


@query(
    "effective_date",
    "SELECT event_id, CAST(time - INTERVAL '6' HOUR AS DATE) AS effective_date FROM heart_rate",
)
def _(v):
    return v.heart_rate.select("event_id", effective_date("time").alias("effective_date"))


@query(
    "anomaly_colour_band",
    """SELECT subject_id, date, CASE WHEN completeness_pct IS NULL AND is_valid_day IS NULL THEN 'none'
  WHEN is_valid_day THEN 'anomaly' WHEN completeness_pct > 0.5 THEN 'elevated' ELSE 'normal' END AS colour FROM quality""",
)
def _(v):
    return v.quality.select(
        "subject_id", "date", op.anomaly_colour_band("completeness_pct", "is_valid_day").alias("colour")
    )


@query(
    "zero_to_null",
    "SELECT id, subject_id, nullif(overall, 0) AS overall, nullif(mental, 0) AS mental FROM condition_logs",
)
def _(v):
    return op.zero_to_null(v.condition_logs, ["overall", "mental"]).select("id", "subject_id", "overall", "mental")


_RAW_STAGES = """CASE WHEN subject_id % 3 = 0 THEN 'inbed' WHEN event_id % 10 = 0 THEN 'unknown'
  WHEN event_id % 4 = 1 THEN 'inbed' ELSE stage END"""


@query(
    "stage_filter",
    f"""WITH s AS (SELECT subject_id, event_id, {_RAW_STAGES} AS stage, seconds - 600 AS seconds FROM sleep_stages),
k AS (SELECT subject_id, bool_or(stage IN ('deep', 'light', 'rem', 'wake')) AS staged FROM s GROUP BY subject_id)
SELECT s.subject_id, event_id, stage, seconds FROM s JOIN k USING (subject_id)
WHERE stage <> 'unknown' AND NOT (staged AND stage = 'inbed') AND seconds > 0""",
)
def _(v):
    s = v.sleep_stages.select(
        "subject_id", "event_id", F.expr(_RAW_STAGES).alias("stage"), (F.col("seconds") - 600).alias("seconds")
    )
    return op.stage_filter(s)


@query(
    "fix_utc_offset",
    f"""SELECT id, {sql_stamp("CASE WHEN extract('hour' FROM t) = 12 AND extract('minute' FROM t) = 0 THEN t - INTERVAL '9' HOUR ELSE t END")} AS logged_at
FROM (SELECT id, CASE WHEN id % 3 = 0 THEN date_trunc('day', logged_at) + INTERVAL '12' HOUR ELSE logged_at END AS t FROM condition_logs) x""",
)
def _(v):
    from kymo.operators.reconcile import fix_utc_offset

    noon = F.date_trunc("day", "logged_at") + F.expr("INTERVAL '12' HOUR")
    logs = v.condition_logs.withColumn("logged_at", F.when(F.col("id") % 3 == 0, noon).otherwise(F.col("logged_at")))
    return fix_utc_offset(logs, "logged_at").select("id", stamp("logged_at").alias("logged_at"))
