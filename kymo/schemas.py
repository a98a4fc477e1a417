"""Declared schemas. Readers never infer; a missing column fails."""

from pyspark.sql import types as T


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


STR, INT, LONG, DBL = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
DATE, TS, BOOL = T.DateType(), T.TimestampType(), T.BooleanType()
TEXTS = T.ArrayType(STR)

TALL_RECORDS = _s(
    ("subject_id", LONG), ("type", STR), ("source_name", STR), ("device", STR),
    ("start", STR), ("end", STR), ("value", STR), ("unit", STR),
)
HEART_RATE = _s(("subject_id", LONG), ("time", TS), ("bpm", INT), ("source", STR))
SLEEP_STAGES = _s(("subject_id", LONG), ("time", TS), ("stage", STR), ("seconds", INT), ("log_id", LONG))
EXERCISE_LOGS = _s(
    ("subject_id", LONG), ("external_id", STR), ("activity_name", STR), ("started_at", TS),
    ("duration_ms", LONG), ("calories", INT), ("avg_hr", INT), ("distance_km", DBL), ("zone_minutes", STR),
)
CONDITION_LOGS = _s(
    ("subject_id", LONG), ("id", LONG), ("logged_at", TS), ("overall", INT), ("mental", INT),
    ("physical", INT), ("energy", INT), ("overall_vas", INT), ("mood_vas", INT), ("energy_vas", INT),
    ("sleep_quality_vas", INT), ("stress_vas", INT), ("note", STR), ("tags", TEXTS),
)
DAILY_SUMMARIES = _s(
    ("subject_id", LONG), ("date", DATE), ("provider", STR), ("resting_hr", INT), ("avg_hr", DBL),
    ("max_hr", INT), ("hrv_daily_rmssd", DBL), ("hrv_deep_rmssd", DBL), ("spo2_avg", DBL),
    ("spo2_min", DBL), ("spo2_max", DBL), ("br_full_sleep", DBL), ("br_deep_sleep", DBL),
    ("br_light_sleep", DBL), ("br_rem_sleep", DBL), ("skin_temp_variation", DBL), ("sleep_start", TS),
    ("sleep_end", TS), ("sleep_duration_min", INT), ("sleep_minutes_asleep", INT),
    ("sleep_minutes_awake", INT), ("sleep_onset_latency", INT), ("sleep_type", STR),
    ("sleep_deep_min", INT), ("sleep_light_min", INT), ("sleep_rem_min", INT), ("sleep_wake_min", INT),
    ("sleep_is_main", BOOL), ("steps", INT), ("distance_km", DBL), ("floors", INT),
    ("calories_total", INT), ("calories_active", INT), ("calories_bmr", INT), ("active_zone_min", INT),
    ("minutes_sedentary", INT), ("minutes_lightly", INT), ("minutes_fairly", INT), ("minutes_very", INT),
    ("vo2_max", DBL), ("hr_zone_out_min", INT), ("hr_zone_fat_min", INT), ("hr_zone_cardio_min", INT),
    ("hr_zone_peak_min", INT), ("synced_at", TS),
)
DATA_QUALITY = _s(
    ("subject_id", LONG), ("date", DATE), ("wear_time_hours", DBL), ("hr_sample_count", LONG),
    ("completeness_pct", DBL), ("metrics_present", TEXTS), ("metrics_missing", TEXTS),
    ("plausibility_flags", T.MapType(STR, STR)), ("plausibility_pass", BOOL), ("is_valid_day", BOOL),
    ("baseline_days", LONG), ("baseline_maturity", STR), ("confidence_score", DBL), ("confidence_level", STR),
)
RUN_LOG = _s(
    ("started_at", TS), ("trigger", STR), ("mode", STR), ("model", STR), ("status", STR),
    ("message", STR), ("model_version", STR), ("training_rows", LONG), ("duration_seconds", DBL),
)
# Test tables the stand-in views read.
EVENTS = _s(("event_id", LONG), ("ts", TS), ("user_id", LONG), ("event_type", STR), ("value", DBL), ("props", STR))
ORDERS = _s(
    ("o_orderkey", LONG), ("o_custkey", LONG), ("o_orderstatus", STR), ("o_totalprice", DBL),
    ("o_orderdate", TS), ("o_orderpriority", STR),
)
LINEITEM = _s(
    ("l_orderkey", LONG), ("l_partkey", LONG), ("l_suppkey", LONG), ("l_linenumber", INT),
    ("l_quantity", DBL), ("l_extendedprice", DBL), ("l_discount", DBL), ("l_tax", DBL),
    ("l_returnflag", STR), ("l_linestatus", STR), ("l_shipdate", TS),
)
DOCUMENTS = _s(("doc_id", LONG), ("text", STR), ("lang", STR), ("source", STR), ("n_chars", LONG))
