"""Rule-based condition score, weekly trend and the daily forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymo.core import SUBJECT, Keys, calendar_frame, dbl
from kymo.functions.clock import local_date
from kymo.operators.filters import risk_signals
from kymo.operators.frames import half_split_trend
from kymo.operators.ranking import sort_by_size

# Factor, value column, baseline column, and rules (condition, points).
_SLEEP_HOURS = "sleep_duration_min / 60"
RULES = [
    ("hrv", "hrv_daily_rmssd", "hrv_7d", [("hrv_delta > 5", 6), ("hrv_delta < -10", -10)]),
    (
        "sleep_duration", "sleep_duration_min", "sleep_7d",
        [(f"{_SLEEP_HOURS} BETWEEN 7 AND 9", 6), (f"{_SLEEP_HOURS} < 5", -16)],
    ),
    ("deep_sleep", "sleep_deep_min", "deep_sleep_7d", [("sleep_deep_min >= 60", 4), ("sleep_deep_min < 30", -6)]),
    ("resting_hr", "resting_hr", "rhr_7d", [("resting_hr_delta > 5", -8)]),
    ("spo2", "spo2_avg", "spo2_7d", [("spo2_avg < 93", -10)]),
    ("steps", "steps", "steps_7d", [("steps_delta > 3000", 4), ("steps_delta < -5000", -4)]),
]
NEUTRAL, RULE_CONFIDENCE, INVALID_CONFIDENCE = 50.0, 0.4, 0.1


def _points(rules: list[tuple[str, int]]) -> Column:
    out = F.lit(0)
    for condition, points in reversed(rules):
        out = F.when(F.expr(condition), points).otherwise(out)
    return out


def condition_score(features: DataFrame) -> DataFrame:
    """Score from 50 by rules on a ``daily_features`` row, confidence and sorted factors.

    A day known to be invalid is 50 with confidence 0.1 and no factors.
    """
    valid = F.coalesce(F.col("is_valid_day"), F.lit(True)) if "is_valid_day" in features.columns else F.lit(True)
    out = features.withColumns({f"_p_{n}": F.when(valid, _points(rules)).otherwise(0) for n, _, _, rules in RULES})
    total = sum((F.col(f"_p_{n}") for n, *_ in RULES), F.lit(NEUTRAL))
    items = [
        F.when(
            F.col(f"_p_{n}") != 0,
            F.struct(
                F.lit(n).alias("feature"),
                F.abs(F.col(f"_p_{n}")).cast("double").alias("importance"),
                F.when(F.col(f"_p_{n}") > 0, "positive").otherwise("negative").alias("direction"),
                F.coalesce(dbl(v), F.lit(0.0)).alias("value"),
                F.coalesce(dbl(b), F.lit(0.0)).alias("baseline"),
            ),
        )
        for n, v, b, _ in RULES
    ]
    quality = dbl("confidence_score") if "confidence_score" in features.columns else F.lit(None).cast("double")
    confidence = F.when(valid, F.least(F.lit(RULE_CONFIDENCE), quality)).otherwise(INVALID_CONFIDENCE)
    return out.withColumns(
        {
            "predicted_score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)),
            "confidence": confidence,
            "contributing_factors": sort_by_size(F.array_compact(F.array(*items)), "importance"),
        }
    ).drop(*[f"_p_{n}" for n, *_ in RULES])


def condition_forecast(features: DataFrame, hrv: DataFrame | None = None, keys: Keys = SUBJECT) -> DataFrame:
    """Condition score with risk signals; an HRV forecast adds a factor and its confidence."""
    on = [*keys, "date"]
    out = risk_signals(condition_score(features))
    out = out.select(*on, "predicted_score", "confidence", "contributing_factors", "risk_signals")
    if hrv is None:
        return out
    z = F.col("predicted_zscore")
    extra = F.when(
        z.isNotNull(),
        F.array(
            F.struct(
                F.lit("hrv_prediction").alias("feature"),
                F.abs(z).alias("importance"),
                F.when(z >= 0, "positive").otherwise("negative").alias("direction"),
                F.bround(z, 3).alias("value"),
                F.lit(0.0).alias("baseline"),
            )
        ),
    )
    joined = out.join(hrv.select(*on, "predicted_zscore", F.col("confidence").alias("_c")), on, "left")
    return joined.select(
        *on,
        "predicted_score",
        F.greatest(F.col("confidence"), F.col("_c")).alias("confidence"),
        F.when(extra.isNotNull(), F.concat("contributing_factors", extra)).otherwise(F.col("contributing_factors")).alias("contributing_factors"),
        "risk_signals",
    )


# Weekly trend messages.
UP = {"hrv": "HRV improving", "sleep": "Sleep duration improving", "steps": "Activity level increasing"}
DOWN = {"hrv": "HRV declining through week", "sleep": "Sleep duration declining"}


def weekly_insight(
    daily: DataFrame, logs: DataFrame, keys: Keys = SUBJECT, days: int = 7, t: str = "logged_at", tz_offset: float = 0
) -> DataFrame:
    """Trend of the week ending on each day: first half of its rows against the rest."""
    on = [*keys, "date"]
    metrics = ["hrv_daily_rmssd", "sleep_duration_min", "steps"]
    half = half_split_trend(daily.select(*on, *metrics), metrics, days, 3, keys)

    # Log sums per day first; days with logs but no summary still count in the mean.
    per_day = logs.groupBy(*keys, local_date(t, tz_offset).alias("date")).agg(
        F.sum(dbl("overall_vas")).alias("_s"), F.count("overall_vas").alias("_n")
    )
    w = calendar_frame(keys, days - 1, include_today=True)
    both = daily.select(*on, F.lit(True).alias("_day")).join(per_day, on, "full")
    scored = both.withColumn("avg_score", F.try_divide(F.sum("_s").over(w), F.sum("_n").over(w))).where("_day")

    pair = lambda c: (F.col(f"{c}_first"), F.col(f"{c}_second"))
    (h1, h2), (s1, s2), (a1, a2) = (pair(c) for c in metrics)
    up = F.array_compact(
        F.array(
            F.when(h2 > h1 * 1.05, UP["hrv"]), F.when(s2 > s1, UP["sleep"]), F.when(a2 > a1 * 1.1, UP["steps"])
        )
    )
    down = F.array_compact(F.array(F.when(h2 < h1 * 0.95, DOWN["hrv"]), F.when(s2 < s1 * 0.9, DOWN["sleep"])))
    out = half.withColumns({"top_factors": up, "risk_summary": down}).join(scored.select(*on, "avg_score"), on, "left")
    more = F.size("top_factors") - F.size("risk_summary")
    trend = (
        F.when(F.col("n_rows") < 3, "insufficient_data")
        .when(more > 0, "improving")
        .when(more < 0, "declining")
        .otherwise("stable")
    )
    return out.select(
        *keys, F.date_sub("date", days - 1).alias("week_start"), F.col("date").alias("week_end"),
        "avg_score", trend.alias("trend"), "top_factors", "risk_summary",
    )
