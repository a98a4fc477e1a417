"""Circular statistics on minutes of the day, as aggregate expressions.

Only sums of sines and cosines reach the shuffle, so partial aggregation applies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from kymo.core import ColumnOrName, dbl

MINUTES = 1440.0
TURN = 2 * math.pi / MINUTES
#: Minutes that rounding of the sums can put a mean off.
NOISE = 1e-9


def angle(minutes: ColumnOrName) -> Column:
    return dbl(minutes) * F.lit(TURN)


def mean_from_parts(sin_mean: Column, cos_mean: Column) -> Column:
    """Minutes in [0, 1440). A mean of midnight is 0 whichever side the rounding of the sums puts it."""
    m = F.pmod(F.atan2(sin_mean, cos_mean) / F.lit(TURN), F.lit(MINUTES))
    return F.when(m >= F.lit(MINUTES - NOISE), F.lit(0.0)).otherwise(m)


def std_from_parts(sin_mean: Column, cos_mean: Column, n: Column) -> Column:
    r = F.sqrt(sin_mean * sin_mean + cos_mean * cos_mean)
    return (
        F.when(n < 2, F.lit(0.0))
        .when(r >= 1.0, F.lit(0.0))
        .when(r <= 0.0, F.lit(720.0))
        .otherwise(F.sqrt(-2.0 * F.ln(F.when(r > 0, r))) / F.lit(TURN))
    )


def circular_mean(minutes: ColumnOrName) -> Column:
    """Aggregate: circular mean in [0, 1440); 0 for an empty group."""
    a = angle(minutes)
    return F.coalesce(mean_from_parts(F.avg(F.sin(a)), F.avg(F.cos(a))), F.lit(0.0))


def circular_std(minutes: ColumnOrName) -> Column:
    a = angle(minutes)
    return std_from_parts(F.avg(F.sin(a)), F.avg(F.cos(a)), F.count(dbl(minutes)))


def circular_distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.when(d > 720, 1440.0 - d).otherwise(d)
