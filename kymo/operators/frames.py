"""Window features over daily series: ROWS frames (training) and calendar frames (serving)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kymo.core import (
    CUSUM_NOISE,
    SUBJECT,
    Keys,
    array_mad,
    array_median,
    calendar_frame,
    cusum_alert,
    day_number,
    dbl,
    frame_of,
    row_frame,
    series,
)
from kymo.functions.numeric import MAD_SCALE, safe_ln


def _add(df: DataFrame, columns: Sequence[str], suffix: str, make) -> DataFrame:
    return df.withColumns({f"{c}_{suffix}": make(c) for c in columns})


def rolling_mean_rows(df: DataFrame, cols: Sequence[str], n: int = 7, keys: Keys = SUBJECT) -> DataFrame:
    w = row_frame(keys, n)
    return _add(df, cols, f"mean_{n}r", lambda c: F.avg(c).over(w))


def rolling_std_rows(df: DataFrame, cols: Sequence[str], n: int = 3, keys: Keys = SUBJECT) -> DataFrame:
    w = row_frame(keys, n)
    return _add(df, cols, f"std_{n}r", lambda c: F.stddev_pop(c).over(w))


def rolling_mean_calendar(
    df: DataFrame, cols: Sequence[str], days: int = 7, include_today: bool = False, keys: Keys = SUBJECT
) -> DataFrame:
    w = calendar_frame(keys, days, include_today)
    return _add(df, cols, f"mean_{days}d", lambda c: F.avg(c).over(w))


def rolling_std_calendar(
    df: DataFrame, cols: Sequence[str], days: int = 3, include_today: bool = False, keys: Keys = SUBJECT
) -> DataFrame:
    w = calendar_frame(keys, days, include_today)
    return _add(df, cols, f"std_{days}d", lambda c: F.stddev_pop(c).over(w))


def rolling_median_calendar(
    df: DataFrame, cols: Sequence[str], days: int = 60, include_today: bool = False, keys: Keys = SUBJECT
) -> DataFrame:
    w = calendar_frame(keys, days, include_today)
    return _add(df, cols, f"median_{days}d", lambda c: F.percentile(dbl(c), F.lit(0.5)).over(w))


def rolling_mad_calendar(
    df: DataFrame, cols: Sequence[str], days: int = 60, include_today: bool = False, keys: Keys = SUBJECT
) -> DataFrame:
    """Exact trailing MAD. A frame holds at most ``days`` + 1 values, so each array is bounded."""
    w = calendar_frame(keys, days, include_today)
    held = df.withColumns({f"_a_{c}": F.collect_list(dbl(c)).over(w) for c in cols})
    held = held.withColumns({f"_m_{c}": array_median(F.col(f"_a_{c}")) for c in cols})
    out = held.withColumns(
        {f"{c}_mad_{days}d": array_mad(F.col(f"_a_{c}"), F.col(f"_m_{c}")) for c in cols}
    )
    return out.drop(*[f"_a_{c}" for c in cols], *[f"_m_{c}" for c in cols])


lateral_rolling_median = rolling_median_calendar


def rolling_mad_sigma(df: DataFrame, cols: Sequence[str], n: int = 60, keys: Keys = SUBJECT) -> DataFrame:
    """Approximate MAD: population deviation times 0.6745 over the previous n rows."""
    w = row_frame(keys, n)
    return _add(df, cols, f"madsigma_{n}r", lambda c: F.stddev_pop(c).over(w) * MAD_SCALE)


def change_rate(x: Column, prev: Column, log: bool = False) -> Column:
    if log:
        return F.when((prev > 0) & (x > 0), F.try_divide(safe_ln(x) - safe_ln(prev), safe_ln(prev)))
    return F.when(prev > 0, F.try_divide(x - prev, prev))


def lag_change_rate(
    df: DataFrame, v: str, log: bool = False, keys: Keys = SUBJECT, out: str | None = None
) -> DataFrame:
    prev = F.lag(dbl(v)).over(series(keys))
    return df.withColumn(out or f"{v}_change_rate", change_rate(dbl(v), prev, log))


def lead_target(df: DataFrame, v: str, keys: Keys = SUBJECT, out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"next_{v}", F.lead(v).over(series(keys)))


def delta_vs_mean(
    df: DataFrame,
    v: str,
    n: int = 7,
    log: bool = False,
    frame: str = "calendar",
    keys: Keys = SUBJECT,
    out: str | None = None,
) -> DataFrame:
    w = frame_of(frame, keys, n)
    if frame == "rows":  # a row without a date comes before no day
        w = Window.partitionBy(*keys).orderBy(day_number("date").asc_nulls_last()).rowsBetween(-n, -1)
    mean = F.avg(dbl(v)).over(w)
    delta = safe_ln(v) - safe_ln(mean) if log else dbl(v) - mean
    return df.withColumn(out or f"{v}_delta", delta)


def prev_day_join(df: DataFrame, cols: Sequence[str], keys: Keys = SUBJECT) -> DataFrame:
    """Values of exactly date - 1 (NULL across a gap), from a one-day RANGE frame: the same
    shuffle as the other windows, no self-join."""
    w = calendar_frame(keys, 1)
    return df.withColumns({f"prev_{c}": F.max(c).over(w) for c in cols})


def today_vs_yesterday(df: DataFrame, cols: Sequence[str], keys: Keys = SUBJECT) -> DataFrame:
    return prev_day_join(df, cols, keys).withColumns(
        {f"{c}_vs_yesterday": F.col(c) - F.col(f"prev_{c}") for c in cols}
    )


def cross_join_scalar(
    df: DataFrame, aggs: dict[str, tuple[str, str, int]], keys: Keys = SUBJECT
) -> DataFrame:
    """Trailing one-row aggregates beside each day, as window columns rather than a cross join.

    ``aggs``: name -> (mean | std, column, days).
    """
    make = {"mean": F.avg, "std": F.stddev_pop}
    return df.withColumns(
        {name: make[kind](c).over(calendar_frame(keys, days)) for name, (kind, c, days) in aggs.items()}
    )


def sequence_windows(
    df: DataFrame, cols: Sequence[str], n: int = 7, frame: str = "calendar", keys: Keys = SUBJECT,
    out: str = "sequence",
) -> DataFrame:
    """The n previous days (or rows) as an array of feature arrays, oldest first; NULL when
    fewer than n are there."""
    w = frame_of(frame, keys, n)
    row = F.struct(F.col("date").alias("d"), F.array(*[dbl(c) for c in cols]).alias("x"))
    held = F.array_sort(F.collect_list(row).over(w))
    return df.withColumn("_seq", held).withColumn(
        out, F.when(F.size("_seq") == n, F.transform("_seq", lambda s: s.x))
    ).drop("_seq")


def cusum_fold(z: Column, k: float = 0.5) -> tuple[Column, Column]:
    """Two-sided CuSum of an array of standardised residuals."""
    zero = F.lit(0.0)
    up = F.aggregate(z, zero, lambda s, x: F.greatest(zero, s + x - k))
    down = F.aggregate(z, zero, lambda s, x: F.greatest(zero, s - x - k))
    return up, down


def cusum_type(up: Column, down: Column, h: float) -> Column:
    return (
        F.when(up > h, "feeling_better_than_expected")
        .when(down > h, "feeling_worse_than_expected")
        .otherwise("aligned")
    )


def cusum(
    df: DataFrame,
    residual: str = "residual",
    mu: float | Column = 0.0,
    sigma: float | Column = 1.0,
    k: float = 0.5,
    h: float = 4.0,
    days: int = 28,
    keys: Keys = SUBJECT,
) -> DataFrame:
    """Control chart restarted for each day over the trailing ``days`` and the day itself."""
    m = mu if isinstance(mu, Column) else F.lit(float(mu))
    s = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
    w = calendar_frame(keys, days, include_today=True)
    item = F.when(F.col(residual).isNotNull(), F.struct(F.col("date").alias("d"), dbl(residual).alias("r")))
    held = df.withColumn("_r", F.array_sort(F.collect_list(item).over(w)))
    held = held.withColumn("_mu", m).withColumn("_sigma", s)
    flat = F.col("_sigma") < 1e-8
    z = F.transform("_r", lambda x: F.try_divide(x.r - F.col("_mu"), F.col("_sigma")))
    held = held.withColumn("_z", F.when(flat | F.col("_sigma").isNull(), F.array().cast("array<double>")).otherwise(z))
    up, down = cusum_fold(F.col("_z"), k)
    out = held.withColumns({"cusum_positive": up, "cusum_negative": down})
    return out.withColumns(
        {
            "cusum_alert": cusum_alert(h),
            "divergence_type": cusum_type(F.col("cusum_positive"), F.col("cusum_negative"), h + CUSUM_NOISE),
        }
    ).drop("_r", "_z", "_mu", "_sigma")


def circular_means(hours: Column, width: int) -> Column:
    """Means of ``width`` consecutive entries of a 24-entry array, wrapping past its end."""
    twice = F.concat(hours, hours)
    return F.transform(
        F.sequence(F.lit(0), F.lit(23)),
        lambda h: F.aggregate(F.slice(twice, h + 1, F.lit(width)), F.lit(0.0), lambda s, x: s + x)
        / F.lit(float(width)),
    )


def first_extreme(means: Column, largest: bool) -> tuple[Column, Column]:
    """Extreme value and its first position; values are rounded so float noise cannot move it."""
    rounded = F.transform(means, lambda x: F.round(x, 9))
    value = F.array_max(rounded) if largest else F.array_min(rounded)
    return value, (F.array_position(rounded, value) - 1).cast("int")


def sliding_circular_window(
    df: DataFrame, hour: str = "hour", v: str = "value", width: int = 10, keys: Keys = SUBJECT
) -> DataFrame:
    """Best and worst ``width``-hour window of a 24-hour profile (one row per hour and key)."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(hour).alias("h"), dbl(v).alias("v"))))
    profile = df.where(F.col(hour).between(0, 23)).groupBy(*keys).agg(
        F.transform(entries, lambda e: e.v).alias("_p")
    ).where(F.size("_p") == 24)
    means = profile.withColumn("_m", circular_means(F.col("_p"), width))
    top, top_at = first_extreme(F.col("_m"), True)
    low, low_at = first_extreme(F.col("_m"), False)
    return means.select(
        *keys, top.alias("max_mean"), top_at.alias("max_start"), low.alias("min_mean"), low_at.alias("min_start")
    )


def half_split_trend(
    df: DataFrame, cols: Sequence[str], days: int = 7, min_rows: int = 3, keys: Keys = SUBJECT
) -> DataFrame:
    """Means of the first floor(n/2) rows and of the rest of each trailing ``days`` window."""
    w = calendar_frame(keys, days - 1, include_today=True)
    item = F.struct(F.col("date").alias("d"), *[dbl(c).alias(c) for c in cols])
    held = df.withColumn("_w", F.array_sort(F.collect_list(item).over(w)))
    n = F.size("_w")
    mid = F.floor(n / 2).cast("int")

    def mean(part: Column, c: str) -> Column:
        # A floor over an empty slice is kept away: slice length is at least 0.
        vals = F.array_compact(F.transform(part, lambda s: s[c]))
        total = F.aggregate(vals, F.lit(0.0), lambda s, x: s + x)
        return F.when(F.size(vals) > 0, total / F.size(vals))

    out = held.withColumn("n_rows", n)
    first = F.slice("_w", F.lit(1), mid)
    rest = F.slice("_w", mid + 1, n - mid)
    enough = n >= min_rows
    return out.withColumns(
        {
            **{f"{c}_first": F.when(enough, mean(first, c)) for c in cols},
            **{f"{c}_second": F.when(enough, mean(rest, c)) for c in cols},
        }
    ).drop("_w")
