"""Date and time column builders. Every zone shift is an explicit number of hours."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from kymo.core import ColumnOrName, bucket, col, epoch_us, shift_hours, DAY_US


def local_date(t: ColumnOrName, tz_offset: float = 0) -> Column:
    return F.to_date(shift_hours(t, tz_offset))


def local_date_from_millis(ms: ColumnOrName, tz_offset: float = 0) -> Column:
    """Epoch milliseconds to a date at a fixed offset."""
    local = col(ms).cast("long") + F.lit(int(tz_offset * 3_600_000))
    return F.date_from_unix_date(bucket(local, DAY_US // 1000).cast("int"))


def noon_day(t: ColumnOrName, tz_offset: float = 0) -> Column:
    """The day d whose window [d-1 12:00, d 12:00) holds t.

    One day per sample: an exact-noon sample goes to the later day only, so no row is
    duplicated on the shuffle.
    """
    return F.to_date(shift_hours(t, tz_offset + 12))


def hours_since_noon(t: ColumnOrName, tz_offset: float = 0) -> Column:
    """Fractional hours since the start of the noon-to-noon window."""
    local = epoch_us(t) + F.lit(int((tz_offset + 12) * 3_600_000_000))
    return F.pmod(local, F.lit(DAY_US)) / F.lit(3_600_000_000.0)


def effective_date(t: ColumnOrName, start_hour: int = 6, tz_offset: float = 0) -> Column:
    """Before ``start_hour`` local, "today" is still yesterday."""
    return F.to_date(shift_hours(t, tz_offset - start_hour))


def minute_of_day(t: ColumnOrName, tz_offset: float = 0) -> Column:
    """Minutes from local midnight, with the seconds as a fraction (microseconds dropped)."""
    local = shift_hours(t, tz_offset)
    return F.hour(local) * 60 + F.minute(local) + F.floor(F.second(local)) / F.lit(60.0)


def day_of_week(date: ColumnOrName) -> Column:
    """0 = Sunday (Spark's dayofweek starts at 1)."""
    return (F.dayofweek(col(date)) - 1).cast("int")


def dow_cyclic(date: ColumnOrName) -> tuple[Column, Column]:
    angle = day_of_week(date) * F.lit(2 * math.pi / 7.0)
    return F.sin(angle), F.cos(angle)


def weekend_flag(date: ColumnOrName) -> Column:
    return F.weekday(col(date)) >= 5


def sleep_midpoint(start: ColumnOrName, end: ColumnOrName, tz_offset: float = 0) -> Column:
    """Midpoint in minutes of the day; a start later than the end crossed midnight."""
    a, b = minute_of_day(start, tz_offset), minute_of_day(end, tz_offset)
    crossed = F.pmod((a + b + 1440.0) / 2.0, F.lit(1440.0))
    return F.when(a > b, crossed).otherwise((a + b) / 2.0)


def age_at(birth: ColumnOrName, on: ColumnOrName) -> Column:
    birth_md = F.month(col(birth)) * 100 + F.dayofmonth(col(birth))
    on_md = F.month(col(on)) * 100 + F.dayofmonth(col(on))
    years = F.year(col(on)) - F.year(col(birth))
    return years - F.when(on_md < birth_md, 1).otherwise(0)


def last_sync(*columns: ColumnOrName) -> Column:
    """Latest of several nullable timestamps."""
    cols = [col(c) for c in columns]
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def cosinor_value(mesor: ColumnOrName, amplitude: ColumnOrName, acrophase: ColumnOrName, hour: Column) -> Column:
    turn = F.lit(2 * math.pi / 24.0)
    return col(mesor) + col(amplitude) * F.cos((hour - col(acrophase)) * turn)
