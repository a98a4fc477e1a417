"""Queries over window features."""

from pyspark.sql import functions as F

from kymo.catalog.registry import DAYNO, cal, query, r, rows
from kymo.operators import frames as op

ORDER = f"(PARTITION BY subject_id ORDER BY {DAYNO})"


@query("rolling_mean_rows", f"SELECT subject_id, date, {r(f'avg(steps) {rows(7)}')} AS steps_mean_7r, {r(f'avg(spo2_avg) {rows(7)}')} AS spo2_avg_mean_7r FROM daily")
def _(v):
    return op.rolling_mean_rows(v.daily, ["steps", "spo2_avg"]).select("subject_id", "date", "steps_mean_7r", "spo2_avg_mean_7r")


@query("rolling_std_rows", f"SELECT subject_id, date, {r(f'stddev_pop(resting_hr) {rows(3)}')} AS resting_hr_std_3r FROM daily")
def _(v):
    return op.rolling_std_rows(v.daily, ["resting_hr"]).select("subject_id", "date", "resting_hr_std_3r")


@query("rolling_mean_calendar", f"SELECT subject_id, date, {r(f'avg(steps) {cal(7)}')} AS steps_mean_7d FROM daily")
def _(v):
    return op.rolling_mean_calendar(v.daily, ["steps"]).select("subject_id", "date", "steps_mean_7d")


@query("rolling_std_calendar", f"SELECT subject_id, date, {r(f'stddev_pop(resting_hr) {cal(3)}')} AS resting_hr_std_3d FROM daily")
def _(v):
    return op.rolling_std_calendar(v.daily, ["resting_hr"]).select("subject_id", "date", "resting_hr_std_3d")


@query(
    "rolling_median_calendar",
    f"SELECT subject_id, date, {r(f'quantile_cont(metric_a, 0.5) {cal(60)}')} AS metric_a_median_60d, {r(f'quantile_cont(metric_b, 0.5) {cal(60)}')} AS metric_b_median_60d FROM long_daily",
)
def _(v):
    out = op.rolling_median_calendar(v.long_daily, ["metric_a", "metric_b"])
    return out.select("subject_id", "date", "metric_a_median_60d", "metric_b_median_60d")


@query(
    "rolling_mad_calendar",
    f"SELECT subject_id, date, {r(f'mad(metric_a) {cal(60)}')} AS metric_a_mad_60d FROM long_daily",
)
def _(v):
    return op.rolling_mad_calendar(v.long_daily, ["metric_a"]).select("subject_id", "date", "metric_a_mad_60d")


@query(
    "rolling_mad_sigma",
    f"SELECT subject_id, date, {r(f'stddev_pop(metric_a) {rows(60)} * 0.6745e0', 4)} AS metric_a_madsigma_60r FROM long_daily",
    digits=4,
)
def _(v):
    return op.rolling_mad_sigma(v.long_daily, ["metric_a"]).select("subject_id", "date", "metric_a_madsigma_60r")


@query(
    "lag_change_rate",
    f"""WITH p AS (SELECT *, lag(resting_hr) OVER {ORDER} AS a, lag(hrv_daily_rmssd) OVER {ORDER} AS b FROM daily)
SELECT subject_id, date, {r('CASE WHEN a > 0 THEN (resting_hr - a) / CAST(a AS DOUBLE) END')} AS rhr_rate,
  {r('CASE WHEN b > 0 AND hrv_daily_rmssd > 0 AND ln(b) <> 0 THEN (ln(hrv_daily_rmssd) - ln(b)) / ln(b) END')} AS hrv_rate FROM p""",
)
def _(v):
    out = op.lag_change_rate(v.daily, "resting_hr", out="rhr_rate")
    out = op.lag_change_rate(out, "hrv_daily_rmssd", log=True, out="hrv_rate")
    return out.select("subject_id", "date", "rhr_rate", "hrv_rate")


@query("lead_target", f"SELECT subject_id, date, lead(steps) OVER {ORDER} AS next_steps FROM daily")
def _(v):
    return op.lead_target(v.daily, "steps").select("subject_id", "date", "next_steps")


@query(
    "delta_vs_mean",
    f"""SELECT subject_id, date, {r(f'steps - avg(steps) {cal(7)}')} AS steps_delta,
  {r(f'CASE WHEN hrv_daily_rmssd > 0 THEN ln(hrv_daily_rmssd) END - ln(avg(hrv_daily_rmssd) {rows(7)})')} AS hrv_delta FROM daily""",
)
def _(v):
    out = op.delta_vs_mean(v.daily, "steps", out="steps_delta")
    out = op.delta_vs_mean(out, "hrv_daily_rmssd", log=True, frame="rows", out="hrv_delta")
    return out.select("subject_id", "date", "steps_delta", "hrv_delta")


@query(
    "cusum",
    f"""WITH s AS (SELECT subject_id, date, metric_b, avg(metric_b) OVER (PARTITION BY subject_id) AS mu, stddev_pop(metric_b) OVER (PARTITION BY subject_id) AS sigma FROM long_daily),
z AS (SELECT subject_id, date, (metric_b - mu) / sigma AS z FROM s),
l AS (SELECT subject_id, date, list(z ORDER BY date) {cal(28, True)} AS zs FROM z),
c AS (SELECT subject_id, date, list_reduce(zs, lambda a, x: greatest(0.0e0, a + x - 0.5e0), 0.0e0) AS up, list_reduce(zs, lambda a, x: greatest(0.0e0, a - x - 0.5e0), 0.0e0) AS down FROM l)
SELECT subject_id, date, {r('up')} AS cusum_positive, {r('down')} AS cusum_negative, (up > 4 OR down > 4) AS cusum_alert,
  CASE WHEN up > 4 THEN 'feeling_better_than_expected' WHEN down > 4 THEN 'feeling_worse_than_expected' ELSE 'aligned' END AS divergence_type FROM c""",
)
def _(v):
    stats = v.long_daily.groupBy("subject_id").agg(F.avg("metric_b").alias("mu"), F.stddev_pop("metric_b").alias("sigma"))
    df = v.long_daily.join(stats, "subject_id")
    out = op.cusum(df, "metric_b", F.col("mu"), F.col("sigma"))
    return out.select("subject_id", "date", "cusum_positive", "cusum_negative", "cusum_alert", "divergence_type")


@query(
    "sequence_windows",
    f"""WITH l AS (SELECT subject_id, date, count(*) {cal(7)} AS n, list(metric_b ORDER BY date) {cal(7)} AS b, list(metric_a ORDER BY date) {cal(7)} AS a FROM long_daily)
SELECT subject_id, date, CAST(CASE WHEN n = 7 THEN 7 END AS INT) AS length, {r('CASE WHEN n = 7 THEN a[1] END')} AS oldest_a, {r('CASE WHEN n = 7 THEN CAST(b[7] AS DOUBLE) END')} AS newest_b FROM l""",
)
def _(v):
    out = op.sequence_windows(v.long_daily, ["metric_a", "metric_b"])
    return out.select(
        "subject_id", "date", F.size("sequence").alias("length"),
        F.get(F.get("sequence", F.lit(0)), F.lit(0)).alias("oldest_a"), F.get(F.get("sequence", F.lit(6)), F.lit(1)).alias("newest_b"),
    ).withColumn("length", F.when(F.col("length") > 0, F.col("length")))


@query(
    "sliding_circular_window",
    f"""WITH h AS (SELECT CAST(event_type AS VARCHAR) AS subject_id, CAST(extract('hour' FROM ts) AS INT) AS hour, avg(value) AS v FROM events GROUP BY ALL),
x AS (SELECT * FROM h UNION ALL SELECT subject_id, hour + 24, v FROM h),
w AS (SELECT subject_id, hour, round(sum(v) OVER (PARTITION BY subject_id ORDER BY hour ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) / 10, 9) AS m FROM x QUALIFY hour < 24)
SELECT subject_id, {r('max(m)')} AS max_mean, CAST(min(hour) FILTER (WHERE m = top) AS INT) AS max_start, {r('min(m)')} AS min_mean, CAST(min(hour) FILTER (WHERE m = low) AS INT) AS min_start
FROM (SELECT *, max(m) OVER (PARTITION BY subject_id) AS top, min(m) OVER (PARTITION BY subject_id) AS low FROM w) y GROUP BY subject_id""",
)
def _(v):
    hours = v.events.groupBy(F.col("event_type").alias("subject_id"), F.hour("ts").alias("hour")).agg(F.avg("value").alias("value"))
    return op.sliding_circular_window(hours)


def sql_half(c: str, side: str) -> str:
    cond = "k <= n // 2" if side == "first" else "k > n // 2"
    return f"CASE WHEN max(n) >= 3 THEN avg(CASE WHEN {cond} THEN {c} END) END"


@query(
    "half_split_trend",
    f"""WITH p AS (SELECT a.subject_id, a.date, b.steps, b.hrv_daily_rmssd, row_number() OVER (PARTITION BY a.subject_id, a.date ORDER BY b.date) AS k,
  count(*) OVER (PARTITION BY a.subject_id, a.date) AS n FROM daily a JOIN daily b ON b.subject_id = a.subject_id AND b.date BETWEEN a.date - 6 AND a.date)
SELECT subject_id, date, CAST(max(n) AS INT) AS n_rows, {r(sql_half('steps', 'first'))} AS steps_first, {r(sql_half('steps', 'second'))} AS steps_second,
  {r(sql_half('hrv_daily_rmssd', 'first'))} AS hrv_daily_rmssd_first, {r(sql_half('hrv_daily_rmssd', 'second'))} AS hrv_daily_rmssd_second FROM p GROUP BY subject_id, date""",
)
def _(v):
    out = op.half_split_trend(v.daily, ["steps", "hrv_daily_rmssd"])
    return out.select(
        "subject_id", "date", "n_rows", "steps_first", "steps_second", "hrv_daily_rmssd_first", "hrv_daily_rmssd_second"
    )
