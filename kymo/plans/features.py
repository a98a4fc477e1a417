"""Feature matrices over daily rows.

``frame="rows"`` counts previous rows (how models are trained), ``frame="calendar"``
counts calendar days (how a day is served). All windows of a matrix share one partitioning
and sort. A caller that wants a date range filters the input to [start - warmup, end]
first and the output to [start, end] after: ``in_range`` does both.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymo.core import SUBJECT, Keys, array_mad, array_median, calendar_frame, dbl, finite, frame_of, row_frame, series
from kymo.functions.clock import day_of_week, dow_cyclic
from kymo.functions.numeric import MAD_SCALE, safe_ln, safe_ratio
from kymo.operators.frames import change_rate
from kymo.operators.joins import join_conditions_inner, join_quality_left

# Feature names in model order.
ANOMALY_FEATURES = [
    "resting_hr", "hrv_ln_rmssd", "sleep_duration_min", "sleep_deep_min", "spo2_avg", "br_full_sleep", "steps",
    "skin_temp_variation", "hrv_deep_ln_rmssd", "hrv_deep_daily_ratio", "resting_hr_delta", "hrv_delta", "sleep_delta",
    "steps_delta", "spo2_delta", "rhr_3d_std", "hrv_3d_std", "sleep_3d_std", "rhr_change_rate", "hrv_change_rate",
    "day_of_week",
]
HRV_FEATURES = [
    "resting_hr", "hrv_ln_rmssd", "sleep_duration_min", "sleep_deep_min", "sleep_rem_min", "spo2_avg", "br_full_sleep",
    "steps", "calories_active", "active_zone_min", "skin_temp_variation", "hrv_deep_ln_rmssd", "hrv_deep_daily_ratio",
    "hrv_deep_delta", "resting_hr_delta", "hrv_delta", "sleep_delta", "steps_delta", "spo2_delta", "rhr_3d_std",
    "hrv_3d_std", "sleep_3d_std", "rhr_change_rate", "hrv_change_rate", "dow_sin", "dow_cos", "z_rhr", "z_hrv",
    "z_sleep_dur",
]
DIVERGENCE_FEATURES = [
    "resting_hr", "hrv_ln_rmssd", "sleep_duration_min", "sleep_deep_min", "spo2_avg", "br_full_sleep", "steps",
    "skin_temp_variation", "vri_score", "day_of_week",
]
# Name of a 7-day mean and its column.
WEEK_MEANS = {
    "rhr_7d": "resting_hr",
    "hrv_7d": "hrv_daily_rmssd",
    "sleep_7d": "sleep_duration_min",
    "steps_7d": "steps",
    "spo2_7d": "spo2_avg",
    "deep_sleep_7d": "sleep_deep_min",
    "br_7d": "br_full_sleep",
}
LINEAR_DELTAS = {
    "resting_hr_delta": ("resting_hr", "rhr_7d"),
    "sleep_delta": ("sleep_duration_min", "sleep_7d"),
    "steps_delta": ("steps", "steps_7d"),
    "spo2_delta": ("spo2_avg", "spo2_7d"),
}
WARMUP_DAYS = 60


def in_range(
    plan: Callable[[DataFrame], DataFrame], daily: DataFrame, start, end, warmup: int = WARMUP_DAYS
) -> DataFrame:
    """Run a windowed plan over a date range. Catalyst cannot push a date filter below a
    window, so the input is cut to the range plus its warm-up by hand."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    warm = daily.where(F.col("date").between(F.date_sub(a, warmup), b))
    return plan(warm).where(F.col("date").between(a, b))


def daily_features(
    daily: DataFrame, quality: DataFrame | None = None, keys: Keys = SUBJECT, frame: str = "calendar"
) -> DataFrame:
    """Raw values, 7-day means, linear deltas, day of week and the quality columns."""
    w = frame_of(frame, keys, 7)
    out = daily.withColumns({n: F.avg(c).over(w) for n, c in WEEK_MEANS.items()})
    deltas = {n: F.col(c) - F.col(m) for n, (c, m) in LINEAR_DELTAS.items()}
    deltas["hrv_delta"] = F.col("hrv_daily_rmssd") - F.col("hrv_7d")
    out = out.withColumns({**deltas, "day_of_week": day_of_week("date")})
    return out if quality is None else join_quality_left(out, quality, keys)


def _shared(daily: DataFrame, frame: str, keys: Keys) -> DataFrame:
    """Features common to the anomaly and the forecast matrix."""
    week, three = frame_of(frame, keys, 7), frame_of(frame, keys, 3)
    if frame == "calendar":
        before = lambda c: F.max(dbl(c)).over(calendar_frame(keys, 1))
    else:
        before = lambda c: F.lag(dbl(c)).over(series(keys))
    windows = {n: F.avg(c).over(week) for n, c in WEEK_MEANS.items() if n not in ("deep_sleep_7d", "br_7d")}
    windows["_deep_ln_7d"] = F.avg(safe_ln("hrv_deep_rmssd")).over(week)
    for n, c in {"rhr": "resting_hr", "hrv": "hrv_daily_rmssd", "sleep": "sleep_duration_min"}.items():
        windows[f"{n}_3d_std"] = F.stddev_pop(c).over(three)
    windows["_prev_rhr"], windows["_prev_hrv"] = before("resting_hr"), before("hrv_daily_rmssd")
    out = daily.withColumns(windows)
    sin, cos = dow_cyclic("date")
    return out.withColumns(
        {
            "hrv_ln_rmssd": safe_ln("hrv_daily_rmssd"),
            "hrv_deep_ln_rmssd": safe_ln("hrv_deep_rmssd"),
            "hrv_deep_daily_ratio": safe_ratio("hrv_deep_rmssd", "hrv_daily_rmssd"),
            "hrv_deep_delta": safe_ln("hrv_deep_rmssd") - F.col("_deep_ln_7d"),
            **{n: F.col(c) - F.col(m) for n, (c, m) in LINEAR_DELTAS.items()},
            "hrv_delta": safe_ln("hrv_daily_rmssd") - safe_ln("hrv_7d"),
            "rhr_change_rate": change_rate(dbl("resting_hr"), F.col("_prev_rhr")),
            "hrv_change_rate": change_rate(dbl("hrv_daily_rmssd"), F.col("_prev_hrv"), log=True),
            "day_of_week": day_of_week("date"),
            "dow_sin": sin,
            "dow_cos": cos,
        }
    )


def _output(df: DataFrame, features: Sequence[str], keys: Keys, *extra: str) -> DataFrame:
    return df.select(*keys, "date", *[finite(c).alias(c) for c in features], *extra)


def anomaly_feature_matrix(
    daily: DataFrame, quality: DataFrame | None = None, frame: str = "calendar", keys: Keys = SUBJECT
) -> DataFrame:
    """21 features per day. With ``quality`` the is_valid_day column comes along."""
    out = _shared(daily, frame, keys)
    if quality is None:
        return _output(out, ANOMALY_FEATURES, keys)
    valid = quality.select(*keys, "date", "is_valid_day")
    return _output(out.join(valid, [*keys, "date"], "left"), ANOMALY_FEATURES, keys, "is_valid_day")


def _z(x: Column, median: Column, mad: Column) -> Column:
    return F.when((mad > 0) & x.isNotNull(), MAD_SCALE * (x - median) / mad)


def hrv_feature_matrix(
    daily: DataFrame, quality: DataFrame | None = None, frame: str = "calendar", keys: Keys = SUBJECT
) -> DataFrame:
    """29 features per day and, for training rows, the next-day target.

    Calendar: exact 60-day median and MAD. Rows: medians over 60 (14 for HRV) calendar days
    with MAD taken as 0.6745 sigma over as many rows, which is how the model is trained.
    """
    out = _shared(daily, frame, keys)
    values = {"rhr": dbl("resting_hr"), "hrv": F.col("hrv_ln_rmssd"), "sleep_dur": dbl("sleep_duration_min")}
    if frame == "calendar":
        w = calendar_frame(keys, 60)
        out = out.withColumns({f"_a_{n}": F.collect_list(x).over(w) for n, x in values.items()})
        out = out.withColumns({f"_m_{n}": array_median(F.col(f"_a_{n}")) for n in values})
        out = out.withColumns({f"_d_{n}": array_mad(F.col(f"_a_{n}"), F.col(f"_m_{n}")) for n in values})
        extra: list[str] = []
    else:
        days = {"rhr": 60, "hrv": 14, "sleep_dur": 60}
        made: dict[str, Column] = {}
        for n, x in values.items():
            made[f"_m_{n}"] = F.percentile(x, F.lit(0.5)).over(calendar_frame(keys, days[n]))
            made[f"_d_{n}"] = F.stddev_pop(x).over(row_frame(keys, days[n])) * MAD_SCALE
        made["_next"] = F.lead(dbl("hrv_daily_rmssd")).over(series(keys))
        out = out.withColumns(made).withColumn(
            "target_hrv_zscore", _z(safe_ln("_next"), F.col("_m_hrv"), F.col("_d_hrv"))
        )
        extra = ["target_hrv_zscore"]
    out = out.withColumns({f"z_{n}": _z(x, F.col(f"_m_{n}"), F.col(f"_d_{n}")) for n, x in values.items()})
    if quality is not None:
        out = out.join(quality.select(*keys, "date", "is_valid_day"), [*keys, "date"], "left")
        extra = [*extra, "is_valid_day"]
    return _output(out, HRV_FEATURES, keys, *extra)


def divergence_day_features(daily: DataFrame, vri: DataFrame | None = None, keys: Keys = SUBJECT) -> DataFrame:
    out = daily.withColumns({"hrv_ln_rmssd": safe_ln("hrv_daily_rmssd"), "day_of_week": day_of_week("date")})
    if vri is not None:
        out = out.join(vri.select(*keys, "date", "vri_score"), [*keys, "date"], "left")
    elif "vri_score" not in out.columns:
        out = out.withColumn("vri_score", F.lit(None).cast("double"))
    return _output(out, DIVERGENCE_FEATURES, keys)


def divergence_feature_matrix(
    daily: DataFrame,
    logs: DataFrame,
    quality: DataFrame,
    vri: DataFrame | None = None,
    t: str = "logged_at",
    tz_offset: float = 0,
    keys: Keys = SUBJECT,
) -> DataFrame:
    """Condition logs paired with their valid day: 10 features, target and a legacy flag."""
    features = divergence_day_features(daily, vri, keys)
    slim = logs.select(
        *keys, F.col("id").alias("condition_log_id"), t, dbl("overall_vas").alias("target_score"),
        F.col("mood_vas").isNull().alias("is_legacy"),
    )
    pairs = join_conditions_inner(
        features, slim, quality.select(*keys, "date", "is_valid_day"), None, t, tz_offset, keys
    )
    return pairs.select(*keys, "date", "condition_log_id", "is_legacy", "target_score", *DIVERGENCE_FEATURES)


