"""Choosing between sources, set operations and repairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymo.core import SUBJECT, Keys, dbl, shift_hours

Predicate = Callable[[Column], Column]


def _aggregate(value: str, agg: str, order: str) -> Column:
    v = dbl(value)
    if agg == "sum":
        return F.bround(F.sum(v), 0)
    if agg == "float_sum":
        return F.sum(v)
    if agg == "avg":
        return F.avg(v)
    if agg == "last":
        return F.max_by(v, F.struct(F.col(order), v))
    raise ValueError(f"unknown aggregate {agg!r}")


def _pick(per_source: DataFrame, group: Sequence[str], rank: str, value: str, plausible: Predicate | None) -> DataFrame:
    """Highest-ranked plausible source; the highest-ranked one when none is plausible."""
    ok = F.coalesce(plausible(F.col(value)), F.lit(False)) if plausible else F.lit(True)
    best = F.max_by(
        F.struct(F.col(value).alias("v"), F.col(rank).alias("r")), F.struct(ok.cast("int"), F.col(rank))
    ).alias("_b")
    return per_source.groupBy(*group).agg(best).select(
        *group, F.col("_b.v").alias(value), F.col("_b.r").alias(rank)
    )


def pick_best_source(
    df: DataFrame,
    value: str = "value",
    agg: str = "sum",
    plausible: Predicate | None = None,
    keys: Keys = (*SUBJECT, "date"),
    rank: str = "source_rank",
    order: str = "start",
) -> DataFrame:
    """Aggregate each source, then take the best one. A day with one source keeps it
    unchecked: with nothing plausible the highest rank wins anyway.

    Sources are pre-aggregated map-side, so the second step sees one row per source.
    """
    group = [*keys]
    per_source = df.groupBy(*group, rank).agg(_aggregate(value, agg, order).alias(value))
    return _pick(per_source, group, rank, value, plausible)


def plausible_pick(
    df: DataFrame,
    preference: Sequence[int],
    plausible: Predicate | None,
    keys: Keys = (*SUBJECT, "date"),
    source: str = "source_id",
    value: str = "value",
) -> DataFrame:
    """One value per source and key; ``preference`` lists source ids, best first."""
    known = df.where(F.col(source).isin(*preference))
    rank = F.lit(len(preference)) - F.array_position(F.array(*[F.lit(s) for s in preference]), F.col(source))
    picked = _pick(known.withColumn("_rank", rank), [*keys], "_rank", value, plausible)
    ids = F.array(*[F.lit(s) for s in preference])
    return picked.select(
        *keys, value, F.element_at(ids, (F.lit(len(preference)) - F.col("_rank")).cast("int")).alias(source)
    )


def priority_pick(
    df: DataFrame, preference: Sequence[int], keys: Keys = (*SUBJECT, "date"), source: str = "source_id",
    value: str = "value",
) -> DataFrame:
    return plausible_pick(df, preference, None, keys, source, value)


def sum_best_source(
    df: DataFrame, value: str = "value", keys: Keys = (*SUBJECT, "date"), rank: str = "source_rank"
) -> DataFrame:
    return pick_best_source(df, value, "sum", None, keys, rank)


def pick_best_minutes(
    df: DataFrame,
    value: str = "value",
    t: str = "start",
    plausible: Predicate | None = None,
    keys: Keys = SUBJECT,
    rank: str = "source_rank",
    tz_offset: float = 0,
) -> DataFrame:
    """1-minute means per source; each local day keeps the minutes of its best source."""
    local = shift_hours(t, tz_offset)
    minutes = df.groupBy(
        *keys, F.to_date(local).alias("date"), F.date_trunc("minute", F.col(t)).alias("minute"), rank
    ).agg(F.bround(F.avg(dbl(value)), 0).cast("int").alias("bpm"))
    means = minutes.groupBy(*keys, "date", rank).agg(F.avg("bpm").alias("_mean"))
    best = _pick(means, [*keys, "date"], rank, "_mean", plausible).drop("_mean")
    return minutes.join(best, [*keys, "date", rank], "left_semi")


def union_dates(*dfs: DataFrame, keys: Keys = SUBJECT) -> DataFrame:
    """Distinct (keys, date) over all frames, each reduced before the union."""
    parts = [d.select(*keys, "date").distinct() for d in dfs]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def backfill_vas(df: DataFrame, src: str, dst: str) -> DataFrame:
    """1-5 to 10..90 where the 0-100 value is missing."""
    return df.withColumn(dst, F.coalesce(F.col(dst), (F.col(src) - 1) * 20 + 10))


def rescale_scores(df: DataFrame, cols: Sequence[str], factor: float = 20.0) -> DataFrame:
    return df.withColumns({c: F.col(c) * F.lit(factor) for c in cols})


def fix_utc_offset(df: DataFrame, t: str, hours: float = 9) -> DataFrame:
    """Rows logged at 12:00 (any second) move back by ``hours``."""
    at_noon = (F.hour(t) == 12) & (F.minute(t) == 0)
    return df.withColumn(t, F.when(at_noon, shift_hours(t, -hours)).otherwise(F.col(t)))


def fill_missing_from(
    df: DataFrame, other: DataFrame, column: str, keys: Keys = (*SUBJECT, "date")
) -> DataFrame:
    """NULL or 0 values come from ``other``; positive values are never overwritten."""
    donor = other.select(*keys, F.col(column).alias("_donor"))
    filled = F.coalesce(F.nullif(F.col(column), F.lit(0)), F.col("_donor"), F.col(column))
    return df.join(donor, list(keys), "left").withColumn(column, filled).drop("_donor")
