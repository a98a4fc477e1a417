"""Numeric column builders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kymo.core import ColumnOrName, col, dbl

# Scale that makes MAD comparable with a standard deviation, the z clamp of
# composite scores, the MAD floor of SpO2, and the logit padding of a 0-100 scale.
MAD_SCALE = 0.6745
Z_CLAMP = 3.0
SPO2_MAD_FLOOR = 1.0
LOGIT_PADDING = 0.5


def safe_ln(x: ColumnOrName) -> Column:
    return F.when(dbl(x) > 0, F.ln(dbl(x)))


def safe_ratio(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.when((dbl(a) > 0) & (dbl(b) > 0), dbl(a) / dbl(b))


def clamp(x: ColumnOrName, low: float, high: float) -> Column:
    """NULL stays NULL (greatest and least skip NULLs, so it is guarded)."""
    value = dbl(x)
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


def robust_z(
    value: ColumnOrName, median: ColumnOrName, mad: ColumnOrName, floor: float = 0.0
) -> Column:
    """Median/MAD z-score; 0 when the spread is 0, NULL when any part is missing."""
    v, m, d = dbl(value), dbl(median), dbl(mad)
    spread = F.greatest(d, F.lit(float(floor)))
    z = F.when(spread == 0, F.lit(0.0)).otherwise(F.try_divide(MAD_SCALE * (v - m), spread))
    return F.when(v.isNotNull() & m.isNotNull() & d.isNotNull(), z)


def tanh_score(z: ColumnOrName, digits: int = 1) -> Column:
    return F.bround(clamp(50.0 + 50.0 * F.tanh(dbl(z) / 2.0), 0.0, 100.0), digits)


def logit_vas(y: ColumnOrName, padding: float = LOGIT_PADDING) -> Column:
    unit = clamp(y, padding, 100.0 - padding) / 100.0
    return F.ln(unit / (1.0 - unit))


def inv_logit_vas(x: ColumnOrName) -> Column:
    return 100.0 / (1.0 + F.exp(-dbl(x)))


def vas_to_legacy(vas: ColumnOrName) -> Column:
    """0-100 scale to 1-5, integer division toward zero."""
    step = F.floor(F.abs(col(vas)) / 20).cast("int") * F.signum(col(vas)).cast("int")
    value = step + 1
    return F.when(col(vas).isNotNull(), F.least(F.lit(5), F.greatest(F.lit(1), value)))


def fraction_to_pct(x: ColumnOrName) -> Column:
    return F.when(dbl(x) <= 1.0, dbl(x) * 100.0).otherwise(dbl(x))


def sleep_efficiency(asleep: ColumnOrName, duration: ColumnOrName) -> Column:
    """Missing when either side is missing or zero."""
    usable = (dbl(asleep) != 0) & (dbl(duration) != 0)
    return F.when(usable, F.bround(F.try_divide(dbl(asleep), dbl(duration)), 4))


def calories_active(total: ColumnOrName, bmr: ColumnOrName) -> Column:
    return F.when(col(total) > col(bmr), col(total) - col(bmr)).otherwise(F.lit(0))


def band(
    x: ColumnOrName, edges: Sequence[float], labels: Sequence[str], side: str = "right"
) -> Column:
    """Label of the first edge that holds: x <= edge for side 'right', x < edge for 'left'.

    ``labels`` has one more entry than ``edges``; NULL gives NULL.
    """
    if len(labels) != len(edges) + 1:
        raise ValueError("labels must have one more entry than edges")
    value = dbl(x)
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        out = out.when(value <= edge if side == "right" else value < edge, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


# Banding tables as (edges, labels, side).
BANDS: dict[str, tuple[list[float], list[str], str]] = {
    "vas_label": (
        [10, 30, 50, 70, 90],
        ["Very Poor", "Poor", "Fair", "Good", "Very Good", "Excellent"],
        "right",
    ),
    "vas_colour": ([25, 50, 75], ["red", "orange", "yellow", "green"], "left"),
    "score": ([50, 70], ["rest", "fair", "good"], "left"),
    "deep_sleep": ([30, 60, 90], ["short", "lowish", "enough", "very good"], "left"),
    "rem_sleep": ([30, 60], ["short", "lowish", "enough"], "left"),
    "onset_latency": ([15, 30], ["good", "fair", "slow"], "right"),
    "sleep_efficiency": ([80, 85], ["improvable", "fair", "good"], "left"),
    "interdaily_stability": ([0.4, 0.6], ["unstable", "fair", "stable"], "left"),
    "midpoint_variability": ([30, 60], ["stable", "somewhat irregular", "irregular"], "right"),
    "active_zone": ([22], ["below target", "target met"], "left"),
    "spo2": ([95], ["lowish", "good"], "left"),
    "who5": ([28, 50], ["warning", "caution", "normal"], "right"),
}


def score_band(x: ColumnOrName, table: str) -> Column:
    edges, labels, side = BANDS[table]
    return band(x, edges, labels, side)


def dip_band(dip: ColumnOrName) -> Column:
    """Nocturnal dip: 10 and 20 per cent both belong to the normal range."""
    d = dbl(dip)
    return F.when(d < 10, "non-dipper").when(d <= 20, "normal").when(d > 20, "extreme dipper")


def pct_diff_band(current: ColumnOrName, baseline: ColumnOrName, integer: bool = False) -> Column:
    """near / above / below a baseline; integer metrics use a plain 5 per cent rule."""
    c, b = dbl(current), dbl(baseline)
    diff = c - b
    pct = F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(F.abs(diff), F.abs(b)) * 100.0)
    near = (pct < 5) if integer else ((F.abs(diff) < 0.5) & (pct < 2))
    return (
        F.when(c.isNull() | b.isNull(), F.lit(None).cast("string"))
        .when(near, "near")
        .when(diff > 0, "above")
        .otherwise("below")
    )


def baseline_maturity(n: ColumnOrName) -> Column:
    """Confidence factor of a baseline by its number of valid days."""
    days = dbl(n)
    return (
        F.when(days < 14, days / 14.0 * 0.5)
        .when(days < 30, 0.5 + (days - 14.0) / 16.0 * 0.3)
        .otherwise(F.least(F.lit(1.0), 0.8 + (days - 30.0) / 30.0 * 0.2))
    )


def maturity_label(n: ColumnOrName, warm_at: int = 30, warm_label: str = "warm") -> Column:
    """cold below 14 days, warming below ``warm_at``. Quality rows use (60, 'mature')."""
    return F.when(col(n) < 14, "cold").when(col(n) < warm_at, "warming").otherwise(F.lit(warm_label))


def divergence_phase(n: ColumnOrName) -> Column:
    pairs = col(n)
    return (
        F.when(pairs < 14, "cold_start")
        .when(pairs < 28, "initial")
        .when(pairs < 60, "baseline")
        .otherwise("full")
    )


def prediction_confidence(n: ColumnOrName, r2: ColumnOrName, completeness: ColumnOrName) -> Column:
    maturity = F.least(F.lit(1.0), dbl(n) / 60.0)
    quality = F.coalesce(F.greatest(F.lit(0.0), dbl(r2)), F.lit(0.0))
    return 0.4 * maturity + 0.3 * quality + 0.3 * dbl(completeness)


def forecast_confidence(mae: ColumnOrName, missing_ratio: ColumnOrName) -> Column:
    base = clamp(1.0 - dbl(mae), 0.0, 1.0)
    return clamp(base * (1.0 - 0.5 * dbl(missing_ratio)), 0.0, 1.0)
