"""Ordered prefix scans that do not put a whole key into one task.

A plain ``Window.partitionBy(key).orderBy(t)`` sends every raw row of a key to one task, so
a subject holding a third of all samples stalls the job. Here rows are windowed per
(key, time chunk); the per-chunk results, one small row per chunk, are scanned per key and
the carried value is joined back on (key, chunk). The result equals the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kymo.core import DAY_US, Keys, bucket, cusum_alert, epoch_us


def prefix_scan(
    df: DataFrame,
    specs: dict[str, tuple[str, Column]],
    keys: Keys,
    t: str,
    tie: Sequence[str] = (),
    chunk_us: int = DAY_US,
) -> DataFrame:
    """Add a running value per spec, over rows ordered by (t, *tie) within ``keys``.

    Kinds: ``max`` and ``sum`` include the current row; ``max_before`` leaves it out;
    ``prev`` is the value of the row just before (NULL on the first row, never NULL inside).
    """
    order = [F.col(t), *[F.col(c) for c in tie]]
    names = list(specs)
    rows = df.withColumn("_chunk", bucket(epoch_us(t), chunk_us))
    for i, name in enumerate(names):
        rows = rows.withColumn(f"_v{i}", specs[name][1])

    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    earlier = local.rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    before = per_chunk.rowsBetween(Window.unboundedPreceding, -1)

    totals, carried, here = [], [], []
    for i, name in enumerate(names):
        kind, v, s = specs[name][0], F.col(f"_v{i}"), F.col(f"_s{i}")
        if kind in ("max", "max_before"):
            totals.append(F.max(v).alias(f"_s{i}"))
            carried.append(F.max(s).over(before).alias(f"_c{i}"))
            here.append(F.max(v).over(upto if kind == "max" else earlier).alias(f"_l{i}"))
        elif kind == "sum":
            totals.append(F.sum(v).alias(f"_s{i}"))
            carried.append(F.sum(s).over(before).alias(f"_c{i}"))
            here.append(F.sum(v).over(upto).alias(f"_l{i}"))
        elif kind == "prev":
            totals.append(F.max_by(v, F.struct(*order)).alias(f"_s{i}"))
            carried.append(F.lag(s).over(per_chunk).alias(f"_c{i}"))
            here.append(F.lag(v).over(local).alias(f"_l{i}"))
        else:
            raise ValueError(f"unknown scan kind {kind!r}")

    on = [*keys, "_chunk"]
    summary = rows.groupBy(*on).agg(*totals).select(*on, *carried)
    scanned = rows.select(*[F.col(c) for c in df.columns], "_chunk", *here).join(summary, on, "left")

    out = []
    for i, name in enumerate(names):
        kind, l, c = specs[name][0], F.col(f"_l{i}"), F.col(f"_c{i}")
        if kind in ("max", "max_before"):
            value = F.greatest(l, c)
        elif kind == "sum":
            value = F.coalesce(l, F.lit(0)) + F.coalesce(c, F.lit(0))
        else:
            value = F.coalesce(l, c)
        out.append(value.alias(name))
    return scanned.select(*[F.col(c) for c in df.columns], *out)


def running_cusum(
    df: DataFrame,
    residual: str,
    mu: float | Column,
    sigma: float | Column,
    keys: Keys,
    t: str,
    tie: Sequence[str] = (),
    k: float = 0.5,
    h: float = 4.0,
    start: DataFrame | None = None,
) -> DataFrame:
    """Two-sided control chart without restarts, as prefix scans.

    The recursion S <- max(0, S + a) has the closed form X - min(-S0, running min of X) with
    X the running sum of a, so no row waits for the one before it. ``start`` holds
    cusum_positive and cusum_negative per key to go on from.
    """
    on = list(keys)
    z = (F.col(residual).cast("double") - mu) / sigma
    rows = df.where(F.col(residual).isNotNull())
    sums = prefix_scan(rows, {"_xu": ("sum", z - k), "_xd": ("sum", -z - k)}, keys, t, tie)
    lows = prefix_scan(sums, {"_mu": ("max", -F.col("_xu")), "_md": ("max", -F.col("_xd"))}, keys, t, tie)
    zero = F.lit(0.0)
    if start is None:
        up0, down0 = zero, zero
    else:
        before = start.select(*on, F.col("cusum_positive").alias("_u0"), F.col("cusum_negative").alias("_d0"))
        lows = lows.join(before, on, "left")
        up0, down0 = F.coalesce("_u0", zero), F.coalesce("_d0", zero)
    out = lows.select(
        *df.columns,
        (F.col("_xu") + F.greatest(up0, F.col("_mu"))).alias("cusum_positive"),
        (F.col("_xd") + F.greatest(down0, F.col("_md"))).alias("cusum_negative"),
    )
    return out.withColumn("cusum_alert", cusum_alert(h))
