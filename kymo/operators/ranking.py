"""Paging, latest rows, top-k arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kymo.core import SUBJECT, ColumnOrName, Keys, col
from kymo.operators.quantiles import attach

SORT_FIELDS = ("logged_at", "overall", "overall_vas", "created_at")


def count_over(df: DataFrame, keys: Keys = SUBJECT, out: str = "total") -> DataFrame:
    """Rows per key beside each row: counted map-side and joined back, so a hot key is
    split by the skew join instead of filling one window partition."""
    totals = df.groupBy(*keys).agg(F.count("*").alias(out))
    return attach(df, totals, keys)


def paged_list(
    df: DataFrame,
    sort: str = "logged_at",
    direction: str = "desc",
    limit: int = 20,
    offset: int = 0,
    max_limit: int = 100,
    keys: Keys = SUBJECT,
    tie: str = "id",
    fields: Sequence[str] = SORT_FIELDS,
) -> DataFrame:
    """One page per key with the total before paging. An unknown sort field falls back to
    the first; the row_number bound lets Spark cut each task to the page before shuffling."""
    field = sort if sort in fields else fields[0]
    limit = min(limit, max_limit) if limit > 0 else 20
    down = direction.lower() != "asc"
    order = [F.col(field).desc_nulls_first() if down else F.col(field).asc_nulls_last(), F.col(tie).asc()]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    page = df.withColumn("row_no", rank).where(F.col("row_no") <= offset + limit).where(F.col("row_no") > offset)
    totals = df.groupBy(*keys).agg(F.count("*").alias("total"))
    return page.join(totals, list(keys))


def latest_row(df: DataFrame, t: str, keys: Keys = SUBJECT, tie: str = "id") -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(t), F.col(tie))).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, "_r.*")


def exercise_range(df: DataFrame, start, end, t: str = "started_at") -> DataFrame:
    return df.where(F.col(t).between(F.lit(start), F.lit(end))).orderBy(F.col(t).desc())


def sort_by_size(arr: ColumnOrName, field: str = "contribution") -> Column:
    """Array of structs by |field| descending; equal sizes keep their order."""
    ranked = F.transform(
        col(arr),
        lambda e, i: F.struct((-F.abs(e[field])).alias("s"), i.alias("i"), e.alias("e")),
    )
    return F.transform(F.array_sort(ranked), lambda r: r.e)


def top_k_drivers(arr: ColumnOrName, k: int = 5, field: str = "contribution") -> Column:
    return F.slice(sort_by_size(arr, field), 1, k)


def top_factors_by_importance(arr: ColumnOrName, field: str = "importance") -> Column:
    return sort_by_size(arr, field)


def dominant_driver(cols: Sequence[str]) -> Column:
    """Name of the column with the largest absolute value; NULL when all are NULL or 0."""
    items = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("z")) for c in cols])
    usable = F.filter(items, lambda e: e.z.isNotNull() & (e.z != 0))
    return F.get(sort_by_size(usable, "z"), F.lit(0))["name"]


def last_n_with_padding(df: DataFrame, end, n: int = 7, keys: Keys = SUBJECT) -> DataFrame:
    """The n days up to ``end`` for every key, oldest first, NULL where a day has no row."""
    last = F.lit(end).cast("date")
    recent = df.where(F.col("date").between(F.date_sub(last, n - 1), last))
    days = df.select(*keys).distinct().withColumn(
        "date", F.explode(F.sequence(F.date_sub(last, n - 1), last))
    )
    return days.join(recent, [*keys, "date"], "left")


def midpoint_mean(df: DataFrame, v: str = "midpoint", n: int = 7, keys: Keys = SUBJECT) -> DataFrame:
    """Mean of the n latest non-NULL values per key."""
    w = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    latest = df.where(F.col(v).isNotNull()).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return latest.groupBy(*keys).agg(F.avg(v).alias("mean_midpoint"), F.count(v).alias("n"))
