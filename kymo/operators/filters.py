"""Projections, filters and rule flags."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymo.core import SUBJECT, ColumnOrName, Keys, col, flags_array
from kymo.operators.quantiles import attach, quantiles_wide


def get_by_date(df: DataFrame, date, column: str = "date") -> DataFrame:
    return df.where(F.col(column) == F.lit(date).cast("date"))


def list_range(df: DataFrame, start, end, column: str = "date") -> DataFrame:
    """Closed date range, in date order; the predicate reaches the scan."""
    return df.where(F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date"))).orderBy(column)


def time_range_half_open(df: DataFrame, t: str, start, end) -> DataFrame:
    return df.where((F.col(t) >= F.lit(start)) & (F.col(t) < F.lit(end)))


def time_range_closed(df: DataFrame, t: str, start, end) -> DataFrame:
    return df.where(F.col(t).between(F.lit(start), F.lit(end)))


def valid_day_filter(df: DataFrame, quality: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    """Keep days whose quality row is TRUE, NULL or absent: an anti-join on invalid days."""
    invalid = quality.where(~F.col("is_valid_day")).select(*keys, "date")
    return df.join(invalid, [*keys, "date"], "left_anti")


# Plausible range of each daily metric, both ends included.
PLAUSIBLE = {
    "resting_hr": ("resting_hr", 30.0, 100.0),
    "hrv_rmssd": ("hrv_daily_rmssd", 5.0, 300.0),
    "spo2": ("spo2_avg", 70.0, 100.0),
    "skin_temp": ("skin_temp_variation", -5.0, 5.0),
    "br": ("br_full_sleep", 4.0, 40.0),
}
# Metric groups of daily completeness and the column that shows each.
COMPLETENESS = {
    "hr": "resting_hr",
    "hrv": "hrv_daily_rmssd",
    "spo2": "spo2_avg",
    "sleep": "sleep_duration_min",
    "activity": "steps",
    "br": "br_full_sleep",
    "temp": "skin_temp_variation",
}
# Completeness groups stored as plain integers, where 0 means no data.
ZERO_IS_ABSENT = ("resting_hr", "sleep_duration_min", "steps")
# Sensor ranges, and the metrics whose 0 means "no data".
SENSOR_RANGES = {
    "resting_hr": (30.0, 100.0),
    "hrv_ln_rmssd": (1.6, 5.7),
    "sleep_duration_min": (0.0, 960.0),
    "sleep_deep_min": (0.0, 480.0),
    "spo2_avg": (70.0, 100.0),
    "br_full_sleep": (5.0, 40.0),
    "steps": (0.0, 100000.0),
    "skin_temp_variation": (-5.0, 5.0),
}
ZERO_SENTINEL = ("resting_hr", "hrv_ln_rmssd", "spo2_avg", "br_full_sleep")
MIN_RHR_STD = 0.5


def plausibility_status(value: ColumnOrName, low: float, high: float, zero_missing: bool = False) -> Column:
    v = col(value)
    missing = v.isNull() | (v == 0) if zero_missing else v.isNull()
    return (
        F.when(missing, "missing").when(v < low, "fail_low").when(v > high, "fail_high").otherwise("pass")
    )


def plausibility_flags(
    df: DataFrame, bounds: Mapping[str, tuple[str, float, float]] = PLAUSIBLE, out: str = "plausibility_flags"
) -> DataFrame:
    pairs = []
    for name, (column, low, high) in bounds.items():
        pairs += [F.lit(name), plausibility_status(column, low, high, column == "resting_hr")]
    return df.withColumn(out, F.create_map(*pairs))


def plausible(flags: str = "plausibility_flags") -> Column:
    return F.forall(F.map_values(flags), lambda s: s.isin("pass", "missing"))


def metric_completeness(df: DataFrame, groups: Mapping[str, str] = COMPLETENESS) -> DataFrame:
    def present(column: str) -> Column:
        c = F.col(column)
        has = c.isNotNull() & (c != 0) if column in ZERO_IS_ABSENT else c.isNotNull()
        return F.coalesce(has, F.lit(False))

    return df.withColumns(
        {
            "metrics_present": flags_array(*[(n, present(c)) for n, c in groups.items()]),
            "metrics_missing": flags_array(*[(n, ~present(c)) for n, c in groups.items()]),
        }
    ).withColumn("completeness_pct", F.size("metrics_present") / F.lit(float(len(groups))))


def sensor_artifacts(
    df: DataFrame,
    bounds: Mapping[str, tuple[float, float]] = SENSOR_RANGES,
    min_std: float = MIN_RHR_STD,
    out: str = "artifacts",
) -> DataFrame:
    named = [("flat_line_hr", F.col("rhr_3d_std") < min_std)]
    for metric, (low, high) in bounds.items():
        v = F.col(metric)
        bad = (v < low) | (v > high)
        named.append((f"out_of_range_{metric}", bad & (v != 0) if metric in ZERO_SENTINEL else bad))
    return df.withColumn(out, flags_array(*named))


# Risk signal, feature, comparison, threshold.
RISK_RULES = [
    ("hrv_significant_drop", "hrv_delta", "<", -15),
    ("rhr_elevated", "resting_hr_delta", ">", 8),
    ("sleep_deficit", "sleep_7d", "<", 360),
    ("spo2_low", "spo2_min", "<", 90),
    ("deep_sleep_low", "sleep_deep_min", "<", 30),
    ("severe_sleep_deprivation", "sleep_duration_min", "<", 240),
    ("breathing_rate_elevated", "br_full_sleep", ">", 20),
]


def risk_signals(df: DataFrame, rules: Sequence[tuple[str, str, str, float]] = RISK_RULES, out: str = "risk_signals") -> DataFrame:
    """Names of the rules that hold; none on a day known to be invalid."""
    valid = F.coalesce(F.col("is_valid_day"), F.lit(True)) if "is_valid_day" in df.columns else F.lit(True)
    named = [
        (name, valid & (F.col(c) < x if op == "<" else F.col(c) > x)) for name, c, op, x in rules
    ]
    return df.withColumn(out, flags_array(*named))


def _outside(column: str, low: int, high: int) -> Column:
    return (F.col(column) < low) | (F.col(column) > high)


def validate_condition(df: DataFrame, out: str = "violations") -> DataFrame:
    """Every violated rule of a condition log (the columns that exist are checked)."""
    named: list[tuple[str, Column]] = []
    if "overall_vas" in df.columns:
        named.append(("overall_vas", F.col("overall_vas").isNull() | _outside("overall_vas", 0, 100)))
    named += [
        (c, _outside(c, 0, 100))
        for c in ("mood_vas", "energy_vas", "sleep_quality_vas", "stress_vas")
        if c in df.columns
    ]
    if "overall" in df.columns:
        named.append(("overall", (F.col("overall") != 0) & _outside("overall", 1, 5)))
    named += [(c, _outside(c, 1, 5)) for c in ("mental", "physical", "energy") if c in df.columns]
    if "note" in df.columns:
        named.append(("note", F.octet_length("note") > 1000))
    if "tags" in df.columns:
        named.append(("tag_count", F.size("tags") > 10))
        named.append(("tag_length", ~F.forall("tags", lambda tag: F.octet_length(tag) <= 50)))
    return df.withColumn(out, flags_array(*named))


def validate_who5(df: DataFrame, out: str = "violations") -> DataFrame:
    named = [(f"item{i}", F.col(f"item{i}").isNull() | _outside(f"item{i}", 0, 5)) for i in range(1, 6)]
    if "period_start" in df.columns:
        named += [
            ("period_start", F.col("period_start").isNull()),
            ("period_end", F.col("period_end").isNull()),
            ("period_order", F.col("period_end") < F.col("period_start")),
        ]
    if "note" in df.columns:
        named.append(("note", F.octet_length("note") > 1000))
    return df.withColumn(out, flags_array(*named))


def tag_contains(df: DataFrame, tag: str, t: str | None = None, start=None, end=None) -> DataFrame:
    out = df.where(F.array_contains("tags", tag))
    if t and start is not None and end is not None:
        out = time_range_closed(out, t, start, end)
    return out


def exclude_dates(df: DataFrame, dates: Iterable[str | dt.date], column: str = "date") -> DataFrame:
    return df.where(~F.col(column).isin([F.lit(d).cast("date") for d in dates]))


def iqr_outlier_filter(df: DataFrame, y: str, mult: float = 3.0, keys: Keys = SUBJECT) -> DataFrame:
    """Keep y in [Q1 - mult*IQR, Q3 + mult*IQR], exact quartiles per key."""
    stats = quantiles_wide(df, [y], {"_q1": 0.25, "_q3": 0.75}, keys)
    q1, q3 = F.col(f"{y}__q1"), F.col(f"{y}__q3")
    spread = (q3 - q1) * mult
    return attach(df, stats, keys).where(F.col(y).between(q1 - spread, q3 + spread)).select(*df.columns)


def zero_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in columns})


def anomaly_colour_band(score: ColumnOrName, flag: ColumnOrName) -> Column:
    return (
        F.when(col(score).isNull() & col(flag).isNull(), "none")
        .when(col(flag), "anomaly")
        .when(col(score) > 0.5, "elevated")
        .otherwise("normal")
    )


def stage_filter(
    df: DataFrame, stage: str = "stage", seconds: str = "seconds", keys: Keys = SUBJECT
) -> DataFrame:
    """Drop unknown stages and non-positive durations; drop ``inbed`` rows of a subject that
    has any staged row. Only one flag per subject is aggregated and joined back."""
    known = df.where(F.col(stage).isin("deep", "light", "rem", "wake", "inbed"))
    staged = known.where(F.col(stage) != "inbed").select(*keys).distinct()
    kept_inbed = known.where(F.col(stage) == "inbed").join(staged, list(keys), "left_anti")
    return (
        known.where(F.col(stage) != "inbed")
        .unionByName(kept_inbed.select(*df.columns))
        .where(F.col(seconds) > 0)
    )
