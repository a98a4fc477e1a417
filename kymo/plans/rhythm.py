"""Circadian metrics of every subject and noon-to-noon day.

Samples are reduced to sums, hourly cells or bit words before anything is windowed, so the
windows see days, not samples.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymo.core import SUBJECT, Keys, bucket, calendar_frame, day_number, epoch_us, seconds_after, shift_hours
from kymo.functions import circular
from kymo.functions.clock import hours_since_noon, noon_day, sleep_midpoint, weekend_flag
from kymo.operators.frames import circular_means, first_extreme
from kymo.operators.intervals import asleep, flag_inside
from kymo.plans.baselines import Metric, composite, trailing_median_mad, z_scores


def _round(x: Column, digits: int | None) -> Column:
    return x if digits is None else F.bround(x, digits)


def cosinor(
    hr: DataFrame,
    keys: Keys = SUBJECT,
    min_samples: int = 720,
    tz_offset: float = 0,
    convention: str = "reference",
    t: str = "time",
    v: str = "bpm",
    digits: int | None = 2,
) -> DataFrame:
    """Least-squares fit of M + A cos(wt - phi) per noon-to-noon day.

    Only the moments of the normal equations are shuffled; they are solved in closed form. They are
    centred, because differences of raw sums lose the fit of a day whose samples lie within minutes.
    Samples without a value do not count.
    ``convention="reference"`` keeps the mirrored acrophase atan2(-b2, b1); "peak" gives the
    hour at which the fitted curve peaks.
    """
    h = hours_since_noon(t, tz_offset) * F.lit(2 * math.pi / 24.0)
    y = F.col(v).cast("double")
    c, s = F.when(y.isNotNull(), F.cos(h)), F.when(y.isNotNull(), F.sin(h))
    x = hr.select(*keys, noon_day(t, tz_offset).alias("date"), y.alias("y"), c.alias("c"), s.alias("s"))
    m = x.groupBy(*keys, "date").agg(
        F.count("y").alias("n_samples"), *[F.avg(n).alias(f"_{n}") for n in ("y", "c", "s")],
        F.var_pop("c").alias("_vc"), F.var_pop("s").alias("_vs"), F.covar_pop("c", "s").alias("_vcs"),
        F.covar_pop("y", "c").alias("_kc"), F.covar_pop("y", "s").alias("_ks"),
    )
    det = F.col("_vc") * F.col("_vs") - F.col("_vcs") * F.col("_vcs")
    det = F.when((F.col("n_samples") >= min_samples) & (det > 1e-12), det)
    m = m.withColumns(
        {
            "_b1": (F.col("_kc") * F.col("_vs") - F.col("_ks") * F.col("_vcs")) / det,
            "_b2": (F.col("_ks") * F.col("_vc") - F.col("_kc") * F.col("_vcs")) / det,
        }
    )
    b1, b2 = F.col("_b1"), F.col("_b2")
    phase = F.atan2(-b2 if convention == "reference" else b2, b1) * F.lit(24 / (2 * math.pi))
    mesor = F.col("_y") - b1 * F.col("_c") - b2 * F.col("_s")
    return m.select(
        *keys,
        "date",
        "n_samples",
        _round(mesor, digits).alias("mesor"),
        _round(F.sqrt(b1 * b1 + b2 * b2), digits).alias("amplitude"),
        _round(F.pmod(phase + 12.0, F.lit(24.0)), digits).alias("acrophase_hour"),
    )


def cosinor_curve(fits: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    """The fitted curve at the 24 hours of each day."""
    from kymo.functions.clock import cosinor_value

    out = fits.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return out.select(*keys, "date", "hour", cosinor_value("mesor", "amplitude", "acrophase_hour", F.col("hour")).alias("value"))


def hourly_cells(
    hr: DataFrame, keys: Keys, min_per_cell: int, tz_offset: float, t: str = "time", v: str = "bpm"
) -> DataFrame:
    """(keys, date, 24-entry array of hourly means from noon; NULL under ``min_per_cell``)."""
    hour = F.floor(hours_since_noon(t, tz_offset)).cast("int")
    cells = hr.groupBy(*keys, noon_day(t, tz_offset).alias("date"), hour.alias("h")).agg(
        F.avg(F.col(v).cast("double")).alias("m"), F.count("*").alias("n")
    )
    kept = F.when(F.col("n") >= min_per_cell, F.col("m"))
    wide = cells.groupBy(*keys, "date").agg(*[F.max(F.when(F.col("h") == h, kept)).alias(f"h{h}") for h in range(24)])
    return wide.select(*keys, "date", F.array(*[f"h{h}" for h in range(24)]).alias("hours"))


WEEK = "between double, all double, steps double, last array<double>"
_CHUNK = 1_000_000  # matrix cells that a task holds at a time


def _sum(rows) -> np.ndarray:
    """Sums in the order given, so they do not depend on how many rows come together."""
    out = 0.0
    for x in rows:
        out = out + x
    return out


def _week(held: pa.ListArray, day: pa.Array, days: int, min_hours: int, min_days: int) -> pa.StructArray:
    n, owner = len(day), np.repeat(np.arange(len(day)), held.value_lengths().to_numpy(zero_copy_only=False))
    at, hours = held.flatten().flatten()
    today = day.cast(pa.float64()).to_numpy(zero_copy_only=False)  # NaN without a date
    slot = at.cast(pa.float64()).to_numpy(zero_copy_only=False) - today[owner] + (days - 1)
    dated = ~np.isnan(slot)
    cells = hours.flatten()
    where = (owner[dated], slot[dated].astype(int))
    x, kept = np.zeros((n, days, 24)), np.zeros((n, days, 24), bool)
    x[where] = cells.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, 24)[dated]
    kept[where] = cells.is_valid().to_numpy(zero_copy_only=False).reshape(-1, 24)[dated]
    count = kept.sum(1)
    ready = ((kept.sum(2) >= min_hours).sum(1) >= min_days) & (count > 0).all(1) & ~np.isnan(today)
    x, kept, count = x[ready], kept[ready], count[ready]
    hour_mean = _sum(np.where(kept[:, d], x[:, d], 0.0) for d in range(days)) / count
    size = days * 24
    full = np.ascontiguousarray(np.where(kept, x, hour_mean[:, None, :]).reshape(-1, size).T)
    avg = _sum(full) / size
    square = lambda v: v * v
    found = [
        _sum(square(hour_mean[:, h] - avg) for h in range(24)),
        _sum(square(v - avg) for v in full),
        _sum(square(full[i + 1] - full[i]) for i in range(size - 1)),
    ]
    row = np.zeros(n, "int64")
    row[ready] = np.arange(ready.sum())
    take = pa.array(row, mask=~ready)
    last = pa.ListArray.from_arrays(np.arange(len(avg) + 1, dtype="int32") * 24, full[-24:].T.ravel())
    return pa.StructArray.from_arrays([*[pa.array(f).take(take) for f in found], last.take(take)], ["between", "all", "steps", "last"])


def week_moments(days: int, min_hours: int, min_days: int):
    """Column function of (cells of the last ``days`` days, day number): sums over the (days x 24) matrix whose empty
    cells take their hour's mean, and its last day; NULL where too few cells are there. Array expressions
    took 0.4 ms a row."""

    @F.arrow_udf(WEEK)
    def moments(held: pa.Array, day: pa.Array) -> pa.Array:
        step = max(1, _CHUNK // (days * 24))
        parts = [_week(held.slice(i, step), day.slice(i, step), days, min_hours, min_days) for i in range(0, len(day), step)]
        return pa.concat_arrays(parts or [_week(held, day, days, min_hours, min_days)])

    return moments


def npar(
    hr: DataFrame,
    keys: Keys = SUBJECT,
    window_days: int = 7,
    min_per_cell: int = 30,
    min_hours: int = 20,
    min_days: int = 3,
    tz_offset: float = 0,
    t: str = "time",
    v: str = "bpm",
    digits: int | None = 4,
) -> DataFrame:
    """Interdaily stability, intradaily variability, relative amplitude, M10 and L5.

    The last ``window_days`` days of hourly means form a (days x 24) matrix; empty cells take
    their hour's mean. An hour without any cell leaves the metrics NULL.
    """
    cells = hourly_cells(hr, keys, min_per_cell, tz_offset, t, v)
    w = calendar_frame(keys, window_days - 1, include_today=True)
    day = day_number("date")
    held = cells.withColumn("_m", F.collect_list(F.struct(day.alias("d"), F.col("hours").alias("x"))).over(w))
    size = window_days * 24
    held = held.select(*keys, "date", week_moments(window_days, min_hours, min_days)(F.col("_m"), day).alias("_w"))
    n = float(size)
    between, every, moved, last = (F.col("_w")[c] for c in ("between", "all", "steps", "last"))
    stable = F.when(every > 0, n * between / (24.0 * every)).otherwise(0.0)
    varied = F.when(every > 0, n * moved / ((n - 1) * every)).otherwise(0.0)
    held = held.withColumns({"_m10": circular_means(last, 10), "_l5": circular_means(last, 5)})
    top, top_at = first_extreme(F.col("_m10"), True)
    low, low_at = first_extreme(F.col("_l5"), False)
    ra = F.when(top + low > 0, (top - low) / (top + low)).otherwise(0.0)
    has = every.isNotNull()
    unit = lambda x, hi: F.greatest(F.lit(0.0), F.least(F.lit(hi), x))
    clock = lambda at: ((at + 12) % 24).cast("double")
    value_digits = None if digits is None else 2
    return held.select(
        *keys,
        "date",
        F.when(has, _round(unit(stable, 1.0), digits)).alias("npar_is"),
        F.when(has, _round(unit(varied, 2.0), digits)).alias("npar_iv"),
        F.when(has, _round(unit(ra, 1.0), digits)).alias("npar_ra"),
        F.when(has, _round(top, value_digits)).alias("m10_value"),
        F.when(has, clock(top_at)).alias("m10_start_hour"),
        F.when(has, _round(low, value_digits)).alias("l5_value"),
        F.when(has, clock(low_at)).alias("l5_start_hour"),
    )


def sleep_timing(
    daily: DataFrame, keys: Keys = SUBJECT, window_days: int = 7, min_days: int = 3, tz_offset: float = 0,
    digits: int | None = 1,
) -> DataFrame:
    """Sleep midpoint, its circular deviation over the week and social jetlag."""
    known = F.col("sleep_start").isNotNull() & F.col("sleep_end").isNotNull()
    mid = F.when(known, sleep_midpoint("sleep_start", "sleep_end", tz_offset))
    w = calendar_frame(keys, window_days - 1, include_today=True)
    angle = circular.angle(F.col("_mid"))
    out = daily.select(*keys, "date", mid.alias("_mid"), weekend_flag("date").alias("_we"))
    parts = {"all": F.lit(True), "we": F.col("_we"), "wd": ~F.col("_we")}
    made = {"_n": F.count("_mid").over(w), "_today": F.last("_mid", ignorenulls=True).over(w)}
    for p, cond in parts.items():
        made[f"_s_{p}"] = F.avg(F.when(cond, F.sin(angle))).over(w)
        made[f"_c_{p}"] = F.avg(F.when(cond, F.cos(angle))).over(w)
    out = out.withColumns(made)
    mean = lambda p: circular.mean_from_parts(F.col(f"_s_{p}"), F.col(f"_c_{p}"))
    jetlag = F.coalesce(circular.circular_distance(mean("we"), mean("wd")), F.lit(0.0))
    enough = F.col("_n") >= min_days
    std = circular.std_from_parts(F.col("_s_all"), F.col("_c_all"), F.col("_n"))
    return out.select(
        *keys,
        "date",
        F.when(enough, _round(F.col("_today") / 60.0, None if digits is None else 2)).alias("sleep_midpoint_hour"),
        F.when(enough, _round(std, digits)).alias("sleep_midpoint_var_min"),
        F.when(enough, _round(jetlag, digits)).alias("social_jetlag_min"),
    )


def nocturnal_dip(
    hr: DataFrame,
    stages: DataFrame,
    keys: Keys = SUBJECT,
    min_samples: int = 720,
    day_hours: tuple[int, int] = (10, 22),
    tz_offset: float = 0,
    t: str = "time",
    v: str = "bpm",
    digits: int | None = 1,
) -> DataFrame:
    """Percentage drop of heart rate from daytime hours to sleep."""
    spans = asleep(stages).select(*keys, F.col("time").alias("start"), seconds_after("time", "seconds").alias("end"))
    marked = flag_inside(hr.select(*keys, t, v), spans, t, "start", "end", keys, out="_asleep")
    hour = F.hour(shift_hours(t, tz_offset))
    by_day = (hour >= day_hours[0]) & (hour < day_hours[1])
    bpm = F.col(v).cast("double")
    out = marked.groupBy(*keys, noon_day(t, tz_offset).alias("date")).agg(
        F.count("*").alias("n_samples"),
        F.avg(F.when(by_day, bpm)).alias("_day"),
        F.avg(F.when(F.col("_asleep"), bpm)).alias("_night"),
    )
    ok = (F.col("n_samples") >= min_samples) & F.col("_night").isNotNull() & (F.col("_day") != 0)
    dip = F.try_divide(F.col("_day") - F.col("_night"), F.col("_day")) * 100.0
    return out.select(
        *keys,
        "date",
        "n_samples",
        F.when(ok, _round(dip, None if digits is None else 2)).alias("nocturnal_dip_pct"),
        F.when(ok, _round(F.col("_day"), digits)).alias("daytime_mean_hr"),
        F.when(ok, _round(F.col("_night"), digits)).alias("nighttime_mean_hr"),
    )


WORD = 64


def sri(
    stages: DataFrame,
    keys: Keys = SUBJECT,
    window_days: int = 7,
    min_days: int = 7,
    epoch: int = 30,
    tz_offset: float = 0,
    tie: str = "seconds",
    dates: DataFrame | None = None,
) -> DataFrame:
    """Sleep regularity: share of 30-second epochs in the same state 24 hours later.

    Epochs are packed 64 to a word (45 words make a day), so an 8-hour night is 15 rows
    instead of 960. Within a word the later stage row overwrites; two words a day apart are
    compared with bit operations. Counts per day pair are summed over each date's window
    once. ``dates`` adds target days without stage rows.
    """
    per_day = 86_400 // epoch
    if per_day % WORD:
        raise ValueError("a day must hold a whole number of 64-epoch words")
    words_per_day = per_day // WORD
    on = [*keys, "date"]
    # Epoch 0 starts at noon of 1970-01-01, so a word never straddles two noon days.
    local = epoch_us("time") + F.lit(int((tz_offset - 12) * 3_600_000_000))
    e0 = bucket(local, epoch * 1_000_000)
    n = F.floor(F.col("seconds") / epoch).cast("long")
    rows = stages.select(
        *keys, "time", F.col(tie).alias("_tie"), F.col("stage").isin("deep", "light", "rem").alias("_asleep"),
        e0.alias("_a"), (e0 + n).alias("_b"),
    ).where(F.col("_b") > F.col("_a"))
    rows = rows.withColumn("_w", F.explode(F.sequence(bucket(F.col("_a"), WORD), bucket(F.col("_b") - 1, WORD))))
    rows = rows.withColumns(
        {
            "_lo": F.greatest(F.col("_a") - F.col("_w") * WORD, F.lit(0)).cast("int"),
            "_hi": F.least(F.col("_b") - F.col("_w") * WORD, F.lit(WORD)).cast("int"),
        }
    )
    rows = rows.withColumn("_mask", F.expr("shiftleft(-1L, _lo) & shiftrightunsigned(-1L, 64 - _hi)"))
    # Of rows covering the same bits of a word only the latest can show, which leaves at most
    # 64 * 65 / 2 rows per word however many stages overlap it.
    latest = F.struct("time", "_tie")
    rows = rows.groupBy(*keys, "_w", "_mask").agg(
        F.max(latest).alias("_at"), F.max_by("_asleep", F.struct("time", "_tie", "_asleep")).alias("_asleep")
    )
    item = F.struct("_at", F.col("_mask").alias("m"), F.col("_asleep").alias("s"))
    words = rows.groupBy(*keys, "_w").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    folded = F.aggregate(
        "_items",
        F.struct(F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("s")),
        lambda acc, x: F.struct(
            acc["k"].bitwiseOR(x["m"]).alias("k"),
            F.when(x["s"], acc["s"].bitwiseOR(x["m"])).otherwise(acc["s"].bitwiseAND(F.bitwise_not(x["m"]))).alias("s"),
        ),
    )
    words = words.select(*keys, "_w", folded.alias("_f")).select(*keys, "_w", "_f.k", "_f.s")
    noon = F.date_from_unix_date((bucket(F.col("_w"), words_per_day) + 1).cast("int"))

    later = words.select(*keys, (F.col("_w") - words_per_day).alias("_w"), F.col("k").alias("k2"), F.col("s").alias("s2"))
    both = words.join(later, [*keys, "_w"], "left")
    known = F.col("k").bitwiseAND(F.col("k2"))
    same = known.bitwiseAND(F.bitwise_not(F.col("s").bitwiseXOR(F.col("s2"))))
    days = both.groupBy(*keys, noon.alias("date")).agg(
        F.coalesce(F.sum(F.bit_count(known)), F.lit(0)).alias("_pairs"),
        F.coalesce(F.sum(F.bit_count(same)), F.lit(0)).alias("_matches"),
        F.lit(1).alias("_has"),
    )
    if dates is not None:
        days = days.join(dates.select(*on).distinct(), on, "full")
    span = calendar_frame(keys, window_days, include_today=True)
    first_of_pair = calendar_frame(keys, window_days)
    out = days.withColumns(
        {
            "days_used": F.count("_has").over(span),
            "pairs": F.coalesce(F.sum("_pairs").over(first_of_pair), F.lit(0)),
            "matches": F.coalesce(F.sum("_matches").over(first_of_pair), F.lit(0)),
        }
    )
    value = F.when(F.col("days_used") >= min_days, F.try_divide(F.col("matches") * 100.0, F.col("pairs")))
    return out.select(*on, value.alias("sri"), "days_used", "pairs")


# Metrics of the circadian score and the dip percentage counted as best.
BEST_DIP = 15.0
CIRCADIAN = {
    "rhythm_strength": (Metric("rhythm_strength", "cosinor_amplitude", 1), "amplitude"),
    "rhythm_stability": (Metric("rhythm_stability", "npar_is", 1), "is"),
    "rhythm_fragmentation": (Metric("rhythm_fragmentation", "npar_iv", -1), "iv"),
    "sleep_regularity": (Metric("sleep_regularity", "sleep_midpoint_var_min", -1), "midpoint_var"),
    "phase_alignment": (Metric("phase_alignment", "_dip_distance", 1), "dip_pct"),
}


def dip_distance() -> Column:
    return -F.abs(F.col("nocturnal_dip_pct") - BEST_DIP)


def circadian_metrics(
    hr: DataFrame,
    stages: DataFrame,
    daily: DataFrame,
    keys: Keys = SUBJECT,
    min_samples: int = 720,
    npar_options: dict | None = None,
    tz_offset: float = 0,
) -> DataFrame:
    """All circadian metrics of a day side by side (outer join on keys and date)."""
    on = [*keys, "date"]
    fit = cosinor(hr, keys, min_samples, tz_offset).select(
        *on, F.col("mesor").alias("cosinor_mesor"), F.col("amplitude").alias("cosinor_amplitude"),
        F.col("acrophase_hour").alias("cosinor_acrophase_hour"),
    )
    rest = npar(hr, keys, tz_offset=tz_offset, **(npar_options or {}))
    timing = sleep_timing(daily, keys, tz_offset=tz_offset)
    dip = nocturnal_dip(hr, stages, keys, min_samples, tz_offset=tz_offset).drop("n_samples")
    return fit.join(rest, on, "full").join(timing, on, "full").join(dip, on, "full")


def circadian_baseline(circ: DataFrame, days: int = 60, keys: Keys = SUBJECT, min_count: int = 7) -> DataFrame:
    """Trailing median / MAD / count of the five metrics over days that have an amplitude."""
    has = F.col("cosinor_amplitude").isNotNull()
    out = circ.withColumn("_dip_distance", dip_distance())
    values = {base: F.when(has, m.value()) for m, base in CIRCADIAN.values()}
    out = trailing_median_mad(out, values, days, min_count, keys)
    return out.withColumn(
        "total_valid_days", F.count(F.when(has, 1)).over(calendar_frame(keys, days))
    ).drop("_dip_distance")


def chs(circ: DataFrame, keys: Keys = SUBJECT, days: int = 60, min_count: int = 7) -> DataFrame:
    """Circadian health score, 0-100, of every day of a circadian metrics table."""
    base = circadian_baseline(circ, days, keys, min_count).withColumn("_dip_distance", dip_distance())
    scored = z_scores(base, CIRCADIAN)
    out = composite(scored, {n: m.direction for n, (m, _) in CIRCADIAN.items()}, "total_valid_days", "chs")
    return out.drop("_dip_distance")
