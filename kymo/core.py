"""Small helpers shared by every operator module."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Keys = Sequence[str]
ColumnOrName = Column | str
SUBJECT: tuple[str, ...] = ("subject_id",)

#: A control chart's sums are within this of exact ones; a sum that equals its limit is no alert.
CUSUM_NOISE = 1e-9

MINUTE_US = 60 * 1_000_000
DAY_US = 86_400 * 1_000_000


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c: ColumnOrName) -> Column:
    return col(c).cast("double")


def finite(c: ColumnOrName) -> Column:
    """NaN and infinities become NULL: the missing-value contract of every metric."""
    x = dbl(c)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def day_number(date: ColumnOrName = "date") -> Column:
    """Days since 1970-01-01, the ordering value of calendar (RANGE) frames."""
    return F.unix_date(col(date))


def epoch_us(t: ColumnOrName) -> Column:
    return F.unix_micros(col(t).cast("timestamp"))


def shift_hours(t: ColumnOrName, hours: float) -> Column:
    if not hours:
        return col(t)
    return col(t) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(hours) * 3600.0))


def seconds_after(t: ColumnOrName, seconds: ColumnOrName) -> Column:
    return F.timestamp_micros(epoch_us(t) + col(seconds).cast("long") * 1_000_000)


def bucket(value: Column, width: int) -> Column:
    """floor(value / width) in integer arithmetic, right for negative values too."""
    return ((value - F.pmod(value, F.lit(width))) / F.lit(width)).cast("long")


def calendar_frame(keys: Keys, days: int, include_today: bool = False, date: str = "date"):
    """Trailing calendar days per series. A series holds one row per key and day, so a
    window partition is bounded by the calendar (36,525 rows a century), whatever the
    number of raw samples behind those days."""
    return (
        Window.partitionBy(*keys)
        .orderBy(day_number(date))
        .rangeBetween(-days, 0 if include_today else -1)
    )


def row_frame(keys: Keys, n: int, include_today: bool = False, date: str = "date"):
    return (
        Window.partitionBy(*keys)
        .orderBy(day_number(date))
        .rowsBetween(-n, 0 if include_today else -1)
    )


def series(keys: Keys, date: str = "date"):
    return Window.partitionBy(*keys).orderBy(day_number(date))


def frame_of(kind: str, keys: Keys, n: int, include_today: bool = False, date: str = "date"):
    if kind == "calendar":
        return calendar_frame(keys, n, include_today, date)
    if kind == "rows":
        return row_frame(keys, n, include_today, date)
    raise ValueError(f"frame must be 'calendar' or 'rows', got {kind!r}")


def array_median(a: Column) -> Column:
    """Median of an array whose length is bounded by its window frame."""
    s = F.array_sort(a)
    n = F.size(a)
    lower = F.get(s, ((n - 1) / 2).cast("int"))
    upper = F.get(s, (n / 2).cast("int"))
    return (lower + upper) / 2.0


def array_mad(a: Column, median: Column) -> Column:
    return array_median(F.transform(a, lambda x: F.abs(x - median)))


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column; adding 0.0 turns -0.0 into 0.0."""
    return df.select(
        *[
            (F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def cusum_alert(h: float) -> Column:
    limit = F.lit(h + CUSUM_NOISE)
    return (F.col("cusum_positive") > limit) | (F.col("cusum_negative") > limit)


def flags_array(*named: tuple[str, Column]) -> Column:
    """Array of the names whose condition holds (NULL counts as not holding), in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named]))
