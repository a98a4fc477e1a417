"""Rolling robust baselines and the composite 0-100 scores built on them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymo.core import SUBJECT, Keys, array_mad, array_median, calendar_frame, dbl, finite
from kymo.functions.numeric import Z_CLAMP, baseline_maturity, clamp, maturity_label, robust_z, safe_ln, tanh_score
from kymo.operators.ranking import sort_by_size


@dataclass(frozen=True)
class Metric:
    """A scored metric: where it comes from and which direction is better."""

    name: str
    column: str
    direction: int = 1
    log: bool = False
    zero_missing: bool = False
    mad_floor: float = 0.0

    def value(self) -> Column:
        if self.log:
            return safe_ln(self.column)
        x = finite(self.column)
        return F.nullif(x, F.lit(0.0)) if self.zero_missing else x


# Baseline metrics. Zero means "no data" except for the sleep minutes.
BASELINE = [
    Metric("ln_rmssd", "hrv_daily_rmssd", log=True, zero_missing=True),
    Metric("rhr", "resting_hr", zero_missing=True),
    Metric("sleep_dur", "sleep_duration_min"),
    Metric("spo2", "spo2_avg", zero_missing=True),
    Metric("deep_sleep", "sleep_deep_min"),
    Metric("br", "br_full_sleep", zero_missing=True),
]
# Metrics of the recovery score, their direction and their baseline.
RECOVERY = {
    "ln_rmssd": (Metric("ln_rmssd", "hrv_daily_rmssd", 1, log=True, zero_missing=True), "ln_rmssd"),
    "resting_hr": (Metric("resting_hr", "resting_hr", -1, zero_missing=True), "rhr"),
    "sleep_duration": (Metric("sleep_duration", "sleep_duration_min", 1), "sleep_dur"),
    "sri": (Metric("sri", "sri_value", 1), "sri"),
    "deep_sleep": (Metric("deep_sleep", "sleep_deep_min", 1), "deep_sleep"),
    "br": (Metric("br", "br_full_sleep", -1, zero_missing=True), "br"),
}


def trailing_median_mad(
    df: DataFrame, values: dict[str, Column], days: int, min_count: int, keys: Keys
) -> DataFrame:
    """``{name}_median``, ``_mad`` and ``_count`` over the previous ``days`` days.

    Each frame is an array of at most ``days`` values (one row per day), so the exact median
    and MAD are array expressions after a single window sort.
    """
    w = calendar_frame(keys, days)
    out = df.withColumns({f"_a_{n}": F.collect_list(x).over(w) for n, x in values.items()})
    out = out.withColumns({f"{n}_count": F.size(f"_a_{n}").cast("long") for n in values})
    enough = {n: F.col(f"{n}_count") >= min_count for n in values}
    out = out.withColumns({f"{n}_median": F.when(enough[n], array_median(F.col(f"_a_{n}"))) for n in values})
    out = out.withColumns(
        {f"{n}_mad": F.when(enough[n], array_mad(F.col(f"_a_{n}"), F.col(f"{n}_median"))) for n in values}
    )
    return out.drop(*[f"_a_{n}" for n in values])


def rolling_baseline(
    daily: DataFrame,
    quality: DataFrame | None = None,
    days: int = 60,
    min_count: int = 7,
    keys: Keys = SUBJECT,
    metrics: Sequence[Metric] = BASELINE,
    valid: str | None = None,
) -> DataFrame:
    """Median, MAD and count of each metric over the previous valid days, for every day.

    Validity comes from ``quality`` or from a column of ``daily`` named by ``valid``.
    """
    out = daily.withColumn("_ok", F.col(valid)) if valid else _with_quality(daily, quality, keys)
    out = trailing_median_mad(
        out, {m.name: F.when(F.col("_ok"), m.value()) for m in metrics}, days, min_count, keys
    )
    total = F.count(F.when(F.col("_ok"), 1)).over(calendar_frame(keys, days))
    return out.withColumns({"total_valid_days": total, "window_days": F.lit(days)}).drop("_ok", "_quality")


def _with_quality(daily: DataFrame, quality: DataFrame | None, keys: Keys) -> DataFrame:
    """Adds ``_ok`` (not known to be invalid) and ``_quality`` (confidence) in one join."""
    nothing = F.lit(None).cast("double")
    if quality is None:
        return daily.withColumns({"_ok": F.lit(True), "_quality": nothing})
    on = [*keys, "date"]
    score = dbl("confidence_score") if "confidence_score" in quality.columns else nothing
    q = quality.select(*on, F.col("is_valid_day").alias("_ok"), score.alias("_quality"))
    return daily.join(q, on, "left").withColumn("_ok", F.coalesce("_ok", F.lit(True)))


def z_scores(df: DataFrame, metrics: dict[str, tuple[Metric, str]]) -> DataFrame:
    return df.withColumns(
        {
            f"z_{name}": robust_z(m.value(), f"{base}_median", f"{base}_mad", m.mad_floor)
            for name, (m, base) in metrics.items()
        }
    )


def factors(directions: dict[str, int], clamped: bool, digits: int = 3) -> Column:
    """Contributions of the metrics that have a z-score, largest first."""
    items = []
    for name, direction in directions.items():
        z = F.col(f"z_{name}")
        directed = clamp(z * direction, -Z_CLAMP, Z_CLAMP) if clamped else z * direction
        items.append(
            F.when(
                z.isNotNull(),
                F.struct(
                    F.lit(name).alias("metric"),
                    F.bround(z, digits).alias("z_score"),
                    F.bround(directed, digits).alias("directed_z"),
                    F.when(directed > 0, "positive").otherwise("negative").alias("direction"),
                    (F.abs(directed) if clamped else F.bround(F.abs(directed), digits)).alias("contribution"),
                ),
            )
        )
    return sort_by_size(F.array_compact(F.array(*items)))


def composite(df: DataFrame, directions: dict[str, int], days_column: str, prefix: str, quality: Column | None = None) -> DataFrame:
    """Mean of the directed, clamped z-scores through tanh, with its confidence."""
    directed = F.array_compact(
        F.array(*[clamp(F.col(f"z_{n}") * d, -Z_CLAMP, Z_CLAMP) for n, d in directions.items()])
    )
    out = df.withColumn("_z", directed)
    n = F.size("_z")
    mean = F.try_divide(F.aggregate("_z", F.lit(0.0), lambda s, x: s + x), n)
    caps = [n / F.lit(float(len(directions))), baseline_maturity(days_column)]
    if quality is not None:
        caps.append(F.coalesce(quality, F.lit(1.0)))
    return out.withColumns(
        {
            f"{prefix}_score": F.when(n == 0, F.lit(50.0)).otherwise(tanh_score(mean)),
            f"{prefix}_confidence": F.when(n == 0, F.lit(0.0)).otherwise(F.bround(F.least(*caps), 3)),
            "baseline_maturity": maturity_label(days_column),
            "contributing_factors": factors(directions, clamped=True),
        }
    ).withColumn("metrics_included", F.transform("contributing_factors", lambda f: f.metric)).drop("_z")


def vri(
    daily: DataFrame,
    stages: DataFrame | None = None,
    quality: DataFrame | None = None,
    metrics: dict[str, tuple[Metric, str]] = RECOVERY,
    sri_baseline: bool = False,
    keys: Keys = SUBJECT,
    days: int = 60,
    min_count: int = 7,
) -> DataFrame:
    """Recovery score of every day, 0-100.

    By default the regularity index has no baseline, so its z-score stays NULL and coverage
    tops out at 5/6; ``sri_baseline=True`` gives it one.
    """
    from kymo.plans.rhythm import sri

    on = [*keys, "date"]
    base = daily
    if stages is None:
        base = base.withColumns({"sri_value": F.lit(None).cast("double"), "sri_days_used": F.lit(0).cast("long")})
    else:
        index = sri(stages, keys, dates=daily.select(*on))
        base = base.join(index.select(*on, F.col("sri").alias("sri_value"), F.col("days_used").alias("sri_days_used")), on, "left")
    tracked = [*BASELINE, Metric("sri", "sri_value")] if sri_baseline else BASELINE
    base = _with_quality(base, quality, keys).withColumns({"_valid": F.col("_ok"), "_confidence": F.col("_quality")})
    scored = rolling_baseline(base.drop("_ok", "_quality"), None, days, min_count, keys, tracked, "_valid")
    if not sri_baseline:
        nothing = F.lit(None).cast("double")
        scored = scored.withColumns({"sri_median": nothing, "sri_mad": nothing, "sri_count": F.lit(0).cast("long")})
    directions = {n: m.direction for n, (m, _) in metrics.items()}
    out = composite(z_scores(scored, metrics), directions, "total_valid_days", "vri", F.col("_confidence"))
    return out.select(
        *on, "vri_score", "vri_confidence", *[f"z_{n}" for n in metrics], "sri_value", "sri_days_used",
        F.col("window_days").alias("baseline_window_days"), "total_valid_days", "baseline_maturity",
        "metrics_included", "contributing_factors",
    )


def vri_factors(df: DataFrame, metrics: dict[str, tuple[Metric, str]] = RECOVERY, out: str = "contributing_factors") -> DataFrame:
    """Factors rebuilt from stored z-scores; unlike the computed ones they are not clamped
    and their contributions are rounded before they are ranked."""
    return df.withColumn(out, factors({n: m.direction for n, (m, _) in metrics.items()}, clamped=False))
