"""Daily data quality, the anomaly gate and training eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.core import SUBJECT, Keys, calendar_frame, dbl
from kymo.functions.clock import local_date
from kymo.functions.numeric import maturity_label
from kymo.operators.filters import metric_completeness, plausibility_flags, plausible, sensor_artifacts


def data_quality(
    daily: DataFrame,
    hr: DataFrame,
    keys: Keys = SUBJECT,
    min_wear: float = 10.0,
    window: int = 60,
    t: str = "time",
    tz_offset: float = 0,
) -> DataFrame:
    """Wear time, validity, baseline maturity and confidence of every day.

    A heart-rate sample stands for one minute; samples are counted per day before the join.
    """
    on = [*keys, "date"]
    samples = hr.groupBy(*keys, local_date(t, tz_offset).alias("date")).agg(F.count("*").alias("hr_sample_count"))
    out = metric_completeness(plausibility_flags(daily.join(samples, on, "left")))
    out = out.withColumn("hr_sample_count", F.coalesce("hr_sample_count", F.lit(0).cast("long")))
    out = out.withColumns(
        {"wear_time_hours": F.col("hr_sample_count") / 60.0, "plausibility_pass": plausible()}
    ).withColumn("is_valid_day", (F.col("wear_time_hours") >= min_wear) & F.col("plausibility_pass"))
    valid_before = F.count(F.when(F.col("is_valid_day"), 1)).over(calendar_frame(keys, window))
    out = out.withColumn("baseline_days", valid_before)
    unit = lambda x: F.least(F.lit(1.0), x)
    out = out.withColumns(
        {
            "baseline_maturity": maturity_label("baseline_days", 60, "mature"),
            "confidence_score": 0.4 * F.col("completeness_pct")
            + 0.3 * unit(F.col("wear_time_hours") / 16.0)
            + 0.3 * unit(F.col("baseline_days") / 60.0),
        }
    )
    score = F.col("confidence_score")
    level = F.when(score < 0.4, "low").when(score <= 0.7, "medium").otherwise("high")
    return out.select(
        *on, "wear_time_hours", "hr_sample_count", "completeness_pct", "metrics_present", "metrics_missing",
        "plausibility_flags", "plausibility_pass", "is_valid_day", "baseline_days", "baseline_maturity",
        "confidence_score", level.alias("confidence_level"),
    )


def anomaly_quality_gate(
    features: DataFrame,
    quality: DataFrame,
    completeness_scale: float = 1.0,
    keys: Keys = SUBJECT,
    min_wear: float = 10.0,
    days: int = 7,
    min_valid: int = 3,
) -> DataFrame:
    """Adds quality_gate and quality_confidence to a feature row.

    Completeness is on a 0-1 scale; ``completeness_scale=100`` divides it once more, as the
    served confidence originally did.
    """
    on = [*keys, "date"]
    has_pass = "plausibility_pass" in quality.columns
    q = quality.select(
        *on,
        F.col("is_valid_day").alias("_valid"),
        dbl("completeness_pct").alias("_complete"),
        dbl("wear_time_hours").alias("_wear"),
        (F.col("plausibility_pass") if has_pass else F.lit(None).cast("boolean")).alias("_plausible"),
        F.lit(True).alias("_has_quality"),
    )
    # Valid days are counted over the quality table, which may hold days without features.
    own = [c for c in features.columns if c not in on and c != "is_valid_day"]
    both = features.select(*on, F.struct(*own).alias("_f")).join(q, on, "full")
    both = both.withColumn("_n", F.count(F.when(F.col("_valid"), 1)).over(calendar_frame(keys, days)))
    rows = both.where(F.col("_f").isNotNull()).select(*on, "_f.*", "_valid", "_complete", "_wear", "_plausible", "_has_quality", "_n")
    rows = sensor_artifacts(rows)
    gate = (
        F.when(F.col("_wear") < min_wear, "insufficient_data")
        .when(F.col("_n") < min_valid, "insufficient_data")
        .when(F.size("artifacts") > 0, "sensor_issue")
        .otherwise("pass")
    )
    one = F.lit(1.0)
    factors = F.least(
        F.when(F.col("_complete").isNotNull(), F.least(one, F.col("_complete") / completeness_scale)),
        F.when(F.col("_wear").isNotNull(), F.least(one, F.col("_wear") / 20.0)),
        F.when(F.col("_plausible"), 1.0).when(~F.col("_plausible"), 0.3),
    )
    confidence = F.coalesce(F.when(F.col("_has_quality"), factors), F.lit(0.5))
    return rows.withColumns({"quality_gate": gate, "quality_confidence": confidence}).drop(
        "_valid", "_complete", "_wear", "_plausible", "_has_quality", "_n"
    )


def train_eligibility(
    daily: DataFrame,
    quality: DataFrame,
    runs: DataFrame,
    min_rows: int,
    as_of,
    keys: Keys = SUBJECT,
    metric: str | None = None,
    min_completeness: float = 0.40,
) -> DataFrame:
    """Three checks per key: enough valid rows, at least one new row, good recent quality.

    ``runs`` holds trained_at per key; ``metric`` restricts to rows where it is present.
    """
    on = [*keys, "date"]
    not_false = F.coalesce(F.col("is_valid_day"), F.lit(True))
    rows = daily if metric is None else daily.where(F.col(metric).isNotNull())
    rows = rows.select(*on).join(quality.where(not_false).select(*on), on)
    last = runs.groupBy(*keys).agg(F.max("trained_at").alias("last_trained"))
    counts = (
        rows.join(last, list(keys), "left")
        .groupBy(*keys)
        .agg(
            F.count("*").alias("available_count"),
            F.count_if(F.col("last_trained").isNull() | (F.col("date") > F.to_date("last_trained"))).alias("new_count"),
        )
    )
    today = F.lit(as_of).cast("date")
    recent = quality.where(F.col("date") >= F.date_sub(today, 7)).groupBy(*keys).agg(
        F.count_if(not_false).alias("recent_valid_days"), F.avg("completeness_pct").alias("recent_completeness")
    )
    subjects = quality.select(*keys).distinct()
    zero = F.lit(0).cast("long")
    out = subjects.join(counts, list(keys), "left").join(recent, list(keys), "left")
    out = out.withColumns(
        {
            "available_count": F.coalesce("available_count", zero),
            "new_count": F.coalesce("new_count", zero),
            "recent_valid_days": F.coalesce("recent_valid_days", zero),
            "recent_completeness": F.coalesce("recent_completeness", F.lit(0.0)),
        }
    )
    reason = (
        F.when(F.col("available_count") < min_rows, "insufficient_data")
        .when(F.col("new_count") == 0, "no_new_data")
        .when((F.col("recent_valid_days") < 3) | (F.col("recent_completeness") < min_completeness), "low_recent_quality")
        .otherwise("ready")
    )
    return out.withColumn("reason", reason).withColumn("trainable", F.col("reason") == "ready")
