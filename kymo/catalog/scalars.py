"""Queries over column builders."""

from pyspark.sql import functions as F

from kymo.catalog.registry import query, r
from kymo.catalog.show import joined
from kymo.functions import clock, numeric as num, text as txt, vocab
from kymo.operators.ranking import sort_by_size

PI2 = "(2 * pi())"


def _daily(name: str, check_cols: str, digits: int = 6):
    return lambda build: query(name, f"SELECT subject_id, date, {check_cols} FROM daily", digits)(
        lambda v: v.daily.select("subject_id", "date", *build())
    )


@_daily("safe_ln", f"{r('CASE WHEN hrv_daily_rmssd > 0 THEN ln(hrv_daily_rmssd) END')} AS ln_rmssd, {r('CASE WHEN skin_temp_variation > 0 THEN ln(skin_temp_variation) END')} AS ln_temp")
def _():
    return num.safe_ln("hrv_daily_rmssd").alias("ln_rmssd"), num.safe_ln("skin_temp_variation").alias("ln_temp")


@_daily("safe_ratio", f"{r('CASE WHEN hrv_deep_rmssd > 0 AND skin_temp_variation > 0 THEN hrv_deep_rmssd / skin_temp_variation END')} AS ratio")
def _():
    return [num.safe_ratio("hrv_deep_rmssd", "skin_temp_variation").alias("ratio")]


@_daily(
    "robust_z",
    f"""{r('CASE WHEN active_zone_min = 0 THEN 0 ELSE 0.6745e0 * (hrv_daily_rmssd - resting_hr) / active_zone_min END + 0 * hrv_daily_rmssd * resting_hr', 9)} AS z,
  {r('0.6745e0 * (spo2_avg - 95) / greatest(0.5e0, 1.0e0)', 9)} AS z_spo2""",
    digits=9,
)
def _():
    return (
        num.robust_z("hrv_daily_rmssd", "resting_hr", "active_zone_min").alias("z"),
        num.robust_z("spo2_avg", F.lit(95), F.lit(0.5), num.SPO2_MAD_FLOOR).alias("z_spo2"),
    )


@_daily("clamp", f"{r('CASE WHEN hrv_daily_rmssd IS NOT NULL THEN greatest(10.0e0, least(60.0e0, hrv_daily_rmssd)) END')} AS clamped")
def _():
    return [num.clamp("hrv_daily_rmssd", 10, 60).alias("clamped")]


@_daily("tanh_score", f"{r('round_even(50 + 50 * tanh((resting_hr - 60) / 13.0e0 / 2), 1)')} AS score")
def _():
    return [num.tanh_score((F.col("resting_hr") - 60) / 13.0).alias("score")]


@_daily("logit_vas", f"{r('ln(least(99.5e0, greatest(0.5e0, spo2_avg)) / 100 / (1 - least(99.5e0, greatest(0.5e0, spo2_avg)) / 100)) + 0 * spo2_avg')} AS logit")
def _():
    return [num.logit_vas("spo2_avg").alias("logit")]


@_daily("inv_logit_vas", f"{r('100.0e0 / (1 + exp(-skin_temp_variation / 10))')} AS vas")
def _():
    return [num.inv_logit_vas(F.col("skin_temp_variation") / 10.0).alias("vas")]


@query("vas_to_legacy", "SELECT id, least(5, greatest(1, overall_vas // 20 + 1)) AS legacy, least(5, greatest(1, mood_vas // 20 + 1)) + 0 * mood_vas AS mood FROM condition_logs")
def _(v):
    return v.condition_logs.select("id", num.vas_to_legacy("overall_vas").alias("legacy"), num.vas_to_legacy("mood_vas").alias("mood"))


@_daily("fraction_to_pct", f"{r('CASE WHEN skin_temp_variation <= 1 THEN skin_temp_variation * 100 ELSE skin_temp_variation END')} AS pct")
def _():
    return [num.fraction_to_pct("skin_temp_variation").alias("pct")]


@_daily("sleep_efficiency", f"{r('CASE WHEN sleep_minutes_asleep <> 0 AND sleep_duration_min <> 0 THEN round_even(sleep_minutes_asleep / CAST(sleep_duration_min AS DOUBLE), 4) END')} AS efficiency")
def _():
    return [num.sleep_efficiency("sleep_minutes_asleep", "sleep_duration_min").alias("efficiency")]


@_daily("calories_active", "CASE WHEN steps > calories_active * 30 THEN steps - calories_active * 30 ELSE 0 END AS active")
def _():
    return [num.calories_active(F.col("steps"), F.col("calories_active") * 30).alias("active")]


_BANDED = {
    "vas_label": "hrv_daily_rmssd", "vas_colour": "hrv_daily_rmssd", "score": "resting_hr", "deep_sleep": "sleep_deep_min",
    "rem_sleep": "sleep_rem_min", "onset_latency": "active_zone_min", "sleep_efficiency": "spo2_avg", "interdaily_stability": "br_full_sleep",
    "midpoint_variability": "active_zone_min", "active_zone": "active_zone_min", "spo2": "spo2_avg", "who5": "active_zone_min",
}


def _band_sql(table: str, column: str) -> str:
    edges, labels, side = num.BANDS[table]
    op = "<=" if side == "right" else "<"
    arms = " ".join(f"WHEN {column} {op} {e} THEN '{label}'" for e, label in zip(edges, labels))
    return f"CASE WHEN {column} IS NULL THEN NULL {arms} ELSE '{labels[-1]}' END AS {table}"


@_daily("score_band", ", ".join(_band_sql(t, c) for t, c in _BANDED.items()) + ", CASE WHEN active_zone_min < 10 THEN 'non-dipper' WHEN active_zone_min <= 20 THEN 'normal' WHEN active_zone_min > 20 THEN 'extreme dipper' END AS dip")
def _():
    return *[num.score_band(c, t).alias(t) for t, c in _BANDED.items()], num.dip_band("active_zone_min").alias("dip")


_PCT = "abs(x - b) / abs(b) * 100"


@query(
    "pct_diff_band",
    f"""SELECT subject_id, date, CASE WHEN x IS NULL OR b IS NULL THEN NULL WHEN abs(x - b) < 0.5 AND (CASE WHEN b = 0 THEN 0 ELSE {_PCT} END) < 2 THEN 'near' WHEN x > b THEN 'above' ELSE 'below' END AS side,
  CASE WHEN s IS NULL OR c IS NULL THEN NULL WHEN (CASE WHEN c = 0 THEN 0 ELSE abs(s - c) / CAST(abs(c) AS DOUBLE) * 100 END) < 5 THEN 'near' WHEN s > c THEN 'above' ELSE 'below' END AS steps_side
FROM (SELECT subject_id, date, spo2_avg AS x, 95.0e0 AS b, steps AS s, calories_active * 30 AS c FROM daily) d""",
)
def _(v):
    return v.daily.select(
        "subject_id", "date", num.pct_diff_band("spo2_avg", F.lit(95.0)).alias("side"),
        num.pct_diff_band("steps", F.col("calories_active") * 30, integer=True).alias("steps_side"),
    )


_MATURITY = "CASE WHEN n < 14 THEN n / 14.0e0 * 0.5e0 WHEN n < 30 THEN 0.5e0 + (n - 14) / 16.0e0 * 0.3e0 ELSE least(1.0e0, 0.8e0 + (n - 30) / 30.0e0 * 0.2e0) END"


@query(
    "baseline_maturity",
    f"""SELECT subject_id, date, {r(_MATURITY)} AS factor, CASE WHEN n < 14 THEN 'cold' WHEN n < 30 THEN 'warming' ELSE 'warm' END AS label,
  CASE WHEN n < 14 THEN 'cold' WHEN n < 60 THEN 'warming' ELSE 'mature' END AS quality_label FROM (SELECT subject_id, date, active_zone_min AS n FROM daily) d""",
)
def _(v):
    d = v.daily
    return d.select(
        "subject_id", "date", num.baseline_maturity("active_zone_min").alias("factor"), num.maturity_label("active_zone_min").alias("label"),
        num.maturity_label("active_zone_min", 60, "mature").alias("quality_label"),
    )


@query(
    "divergence_phase",
    "SELECT subject_id, date, CASE WHEN active_zone_min < 14 THEN 'cold_start' WHEN active_zone_min < 28 THEN 'initial' WHEN active_zone_min < 60 THEN 'baseline' ELSE 'full' END AS phase FROM daily",
)
def _(v):
    return v.daily.select("subject_id", "date", num.divergence_phase("active_zone_min").alias("phase"))


@query(
    "prediction_confidence",
    f"""SELECT subject_id, date, {r('0.4e0 * least(1.0e0, active_zone_min / 60.0e0) + 0.3e0 * greatest(0.0e0, skin_temp_variation / 100) + 0.3e0 * spo2_avg / 100', 9)} AS ridge,
  CASE WHEN spo2_avg IS NOT NULL AND skin_temp_variation IS NOT NULL THEN {r('greatest(0.0e0, least(1.0e0, greatest(0.0e0, least(1.0e0, 1 - skin_temp_variation / 50)) * (1 - 0.5e0 * spo2_avg / 100)))', 9)} END AS forecast FROM daily""",
    digits=9,
)
def _(v):
    d = v.daily
    return d.select(
        "subject_id", "date",
        num.prediction_confidence("active_zone_min", F.col("skin_temp_variation") / 100, F.col("spo2_avg") / 100).alias("ridge"),
        num.forecast_confidence(F.col("skin_temp_variation") / 50, F.col("spo2_avg") / 100).alias("forecast"),
    )


@query("noon_day", f"SELECT event_id, CAST(time + INTERVAL '12' HOUR AS DATE) AS noon_day, {r('(epoch_us(time) + 43200000000) % 86400000000 / 3600000000.0e0')} AS hours FROM heart_rate")
def _(v):
    return v.heart_rate.select("event_id", clock.noon_day("time").alias("noon_day"), clock.hours_since_noon("time").alias("hours"))


@query("local_date", "SELECT event_id, CAST(time + INTERVAL '9' HOUR AS DATE) AS from_time, CAST(time + INTERVAL '9' HOUR AS DATE) AS from_millis FROM heart_rate")
def _(v):
    return v.heart_rate.select(
        "event_id", clock.local_date("time", 9).alias("from_time"), clock.local_date_from_millis(F.unix_millis("time"), 9).alias("from_millis")
    )


@_daily("dow_cyclic", f"{r(f'sin({PI2} * dayofweek(date) / 7.0e0)')} AS dow_sin, {r(f'cos({PI2} * dayofweek(date) / 7.0e0)')} AS dow_cos, CAST(dayofweek(date) AS INT) AS dow")
def _():
    s, c = clock.dow_cyclic("date")
    return s.alias("dow_sin"), c.alias("dow_cos"), clock.day_of_week("date").alias("dow")


@_daily("weekend_flag", "isodow(date) >= 6 AS weekend")
def _():
    return [clock.weekend_flag("date").alias("weekend")]


def sql_minute(t: str) -> str:
    return f"(extract('hour' FROM {t}) * 60 + extract('minute' FROM {t}) + floor(extract('second' FROM {t})) / 60.0e0)"


def sql_midpoint(a: str = "sleep_start", b: str = "sleep_end") -> str:
    x, y = sql_minute(a), sql_minute(b)
    return f"CASE WHEN {x} > {y} THEN (({x} + {y} + 1440.0e0) / 2.0e0) % 1440.0e0 ELSE ({x} + {y}) / 2.0e0 END"


@_daily("sleep_midpoint", f"{r(sql_midpoint())} AS midpoint")
def _():
    return [clock.sleep_midpoint("sleep_start", "sleep_end").alias("midpoint")]


@_daily("age_at", "CAST(date_part('year', age(CAST(date AS TIMESTAMP), CAST(DATE '1950-01-12' + CAST((subject_id * 997) % 18000 AS INT) AS TIMESTAMP))) AS INT) AS age")
def _():
    born = F.expr("date_add(DATE '1950-01-12', CAST((subject_id * 997) % 18000 AS INT))")
    return [clock.age_at(born, "date").alias("age")]


_EXPORT = """CASE event_id % 7 WHEN 0 THEN 'SleepAnalysisAsleepCore' WHEN 1 THEN 'SleepAnalysisAsleepDeep' WHEN 2 THEN 'SleepAnalysisAsleepREM'
  WHEN 3 THEN 'SleepAnalysisAwake' WHEN 4 THEN 'SleepAnalysisInBed' WHEN 5 THEN 'SleepAnalysisAsleepUnspecified' ELSE event_type END"""
_WORD = "CASE event_id % 6 WHEN 0 THEN 'Restless' WHEN 1 THEN 'asleep' WHEN 2 THEN 'AWAKE' WHEN 3 THEN 'Deep' WHEN 4 THEN 'rem' ELSE event_type END"


@query(
    "map_stage_text",
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'light' WHEN 1 THEN 'deep' WHEN 2 THEN 'rem' WHEN 3 THEN 'wake' WHEN 4 THEN 'inbed' WHEN 5 THEN 'light' ELSE 'unknown' END AS stage,
  CASE event_id % 7 WHEN 0 THEN 'light' WHEN 1 THEN 'light' WHEN 2 THEN 'light' WHEN 3 THEN 'wake' WHEN 4 THEN 'inbed' WHEN 5 THEN 'light' ELSE 'unknown' END AS legacy,
  CASE event_id % 6 WHEN 0 THEN 'wake' WHEN 1 THEN 'light' WHEN 2 THEN 'wake' WHEN 3 THEN 'deep' WHEN 4 THEN 'rem' ELSE event_type END AS provider FROM events""",
)
def _(v):
    e = v.events.select("event_id", F.expr(_EXPORT).alias("a"), F.expr(_WORD).alias("b"))
    return e.select(
        "event_id", vocab.map_stage_text("a").alias("stage"), vocab.map_stage_text("a", legacy=True).alias("legacy"),
        vocab.map_stage_text("b", "provider").alias("provider"),
    )


@query("map_stage_code", "SELECT event_id, CASE event_id % 8 WHEN 1 THEN 'wake' WHEN 2 THEN 'light' WHEN 4 THEN 'light' WHEN 5 THEN 'deep' WHEN 6 THEN 'rem' END AS stage FROM events")
def _(v):
    return v.events.select("event_id", vocab.map_stage_code(F.col("event_id") % 8).alias("stage"))


_CASES = " ".join(f"WHEN {c} THEN '{n}'" for c, n in vocab.EXERCISES.items())


@query("map_exercise_code", f"SELECT event_id, CASE event_id % 82 {_CASES} ELSE 'Other' END AS activity_name FROM events")
def _(v):
    e = v.events.select("event_id", (F.col("event_id") % 82).cast("int").alias("code"))
    return vocab.map_exercise_code(e).select("event_id", "activity_name")


_RANGE = """CASE event_id % 5 WHEN 0 THEN concat(CAST(event_id AS VARCHAR(20)), ' - ', CAST(event_id + 5 AS VARCHAR(20))) WHEN 1 THEN CAST(event_id AS VARCHAR(20))
  WHEN 2 THEN event_type WHEN 3 THEN concat(event_type, '-5') ELSE '' END"""


@query("parse_range_midpoint", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id + 2.5e0 WHEN 1 THEN CAST(event_id AS DOUBLE) END AS midpoint FROM events")
def _(v):
    return v.events.select("event_id", vocab.parse_range_midpoint(F.expr(_RANGE)).alias("midpoint"))


@query(
    "cosinor_curve",
    f"""SELECT subject_id, date, CAST(h AS INT) AS hour, {r(f'resting_hr + spo2_avg * cos((h - active_zone_min) * {PI2} / 24)')} AS value
FROM daily, (SELECT unnest(range(24)) AS h) u""",
)
def _(v):
    d = v.daily
    d = d.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return d.select("subject_id", "date", "hour", clock.cosinor_value("resting_hr", "spo2_avg", "active_zone_min", F.col("hour")).alias("value"))


_CODES = "CASE event_id % 5 WHEN 0 THEN 'spo2_avg' WHEN 1 THEN 'z_sri' WHEN 2 THEN 'vo2_max' WHEN 3 THEN 'night_of_sleep' ELSE event_type END"


@query(
    "humanize_feature",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'SpO2' WHEN 1 THEN 'SRI Z-score' WHEN 2 THEN 'VO2 Max' WHEN 3 THEN 'Night Of Sleep'
  ELSE upper(substr(event_type, 1, 1)) || substr(event_type, 2) END AS label FROM events""",
)
def _(v):
    return v.events.select("event_id", vocab.humanize_feature(F.expr(_CODES)).alias("label"))


@query(
    "json_list",
    """SELECT id, CAST(to_json(string_split(tags_csv, ',')) AS VARCHAR) AS tags_json, string_split(tags_csv, ',')[2] AS second_tag FROM condition_logs""",
)
def _(v):
    made = v.condition_logs.select("id", txt.json_list("tags").alias("tags_json"))
    return made.select("id", "tags_json", F.get(txt.parse_json_list("tags_json", "ARRAY<STRING>"), F.lit(1)).alias("second_tag"))


@query("content_hash", "SELECT doc_id, substr(sha256(concat(lang, text)), 1, 16) AS content_hash FROM documents")
def _(v):
    return v.documents.select("doc_id", txt.content_hash("lang", "text").alias("content_hash"))


# Settings that occur in the documents: sentence end, phrases and greetings.
_PHRASES = [("the", "THE"), ("und", "UND")]
_GREETINGS = ["The", "Le"]


def _clean_sql() -> str:
    emoji, edges = txt.EMOJI, txt.EDGES.replace("'", "''")
    notes = "\n".join(f"p{i} AS (SELECT *, contains(t{i}, '{o}') AS hit{i}, replace(t{i}, '{o}', '{n}') AS t{i + 1} FROM p{i - 1})," for i, (o, n) in enumerate(_PHRASES))
    k = len(_PHRASES)
    hits = ", ".join(f"CASE WHEN hit{i} THEN 'medical_term_replaced: {o}' END" for i, (o, _n) in enumerate(_PHRASES))
    greet = " OR ".join(f"contains(first_line, '{g}')" for g in _GREETINGS)
    return f"""WITH p AS (SELECT doc_id, regexp_replace(regexp_replace(text, '{txt.FENCE}', '', 'g'), '{emoji}', '', 'g') AS t0 FROM documents),
{notes.replace('FROM p-1', 'FROM p')}
c AS (SELECT *, regexp_replace(regexp_replace(t{k}, '{txt.BLANKS}', chr(10) || chr(10), 'g'), '{edges}', '', 'g') AS t FROM p{k - 1}),
n AS (SELECT *, length(t) AS n, substr(t, 1, 1500) AS head FROM c),
l AS (SELECT *, CASE WHEN contains(head, '.') THEN length(head) - instr(reverse(head), '.') + 1 ELSE 0 END AS last FROM n),
o AS (SELECT *, CASE WHEN n <= 1500 THEN t WHEN last - 1 > 500 THEN substr(t, 1, last) ELSE head END AS clean_text FROM l),
g AS (SELECT *, string_split(clean_text, chr(10))[1] AS first_line FROM o)
SELECT doc_id, clean_text, array_to_string(list_filter([{hits},
  CASE WHEN n > 1500 THEN concat('truncated: ', n, ' -> ', length(clean_text)) WHEN n < 400 THEN concat('short_output: ', n, ' chars') END,
  CASE WHEN NOT ({greet}) THEN 'missing_greeting' END], lambda x: x IS NOT NULL), ',') AS warnings FROM g"""


@query("clean_generated_text", _clean_sql())
def _(v):
    out = txt.clean_generated_text(v.documents.select("doc_id", "text"), phrases=_PHRASES, greetings=_GREETINGS, sentence_end=".")
    return out.select("doc_id", "clean_text", joined("warnings").alias("warnings"))


_DRIVERS = [("resting_hr", "resting hr", " bpm"), ("spo2_avg", "spo2", " %"), ("br_full_sleep", "breathing rate", " br/min"), ("steps", "steps", " steps")]
_SAID = " UNION ALL ".join(
    f"SELECT subject_id, date, {i} AS i, '{name} was ' || CASE WHEN v = floor(v) THEN printf('%.0f', v) ELSE printf('%.1f', v) END || '{unit}' AS said, 40.0e0 - coalesce(v, 0) AS c FROM (SELECT subject_id, date, CAST({col} AS DOUBLE) AS v FROM daily) x"
    for i, (col, name, unit) in enumerate(_DRIVERS)
)


@query(
    "explain_text",
    f"""WITH a AS ({_SAID}), k AS (SELECT *, row_number() OVER (PARTITION BY subject_id, date ORDER BY abs(c) DESC, i) AS n FROM a),
g AS (SELECT subject_id, date, list(said ORDER BY n) FILTER (n <= 3 AND c < 0) AS s FROM k GROUP BY subject_id, date)
SELECT subject_id, date, CASE WHEN s IS NULL THEN 'No strong anomaly drivers detected.'
  WHEN len(s) = 1 THEN 'Your health pattern today was unusual — the main driver was ' || s[1] || '.'
  ELSE 'Your health pattern today was unusual — the main driver was ' || s[1] || ', combined with ' || s[2] || '.' END AS explanation FROM g""",
)
def _(v):
    cols = ["resting_hr", "spo2_avg", "br_full_sleep", "steps"]
    arr = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), (F.lit(40.0) - F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias("contribution"))
            for c in cols
        ]
    )
    d = v.daily.withColumn("drivers", sort_by_size(arr))
    return d.select("subject_id", "date", txt.explain_text("drivers").alias("explanation"))
