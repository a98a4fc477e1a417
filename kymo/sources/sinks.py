"""Sinks: merge rules as joins, and partition overwrite.

Plain parquet has no MERGE, so an upsert is a full outer join on the key. The rules here give the
merged rows of the frames they are given; ``filetable.upsert_files`` gives them only the old rows of
files that hold a touched key. Keys that repeat in the new rows are folded first, in ``order`` (of all
columns where none is given), as if the rows had come one after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymo.core import SUBJECT, Keys
from kymo.operators.intervals import flag_inside


def _merge(
    old: DataFrame, new: DataFrame, on: Sequence[str], rule: Callable[[str, Column, Column, Column], Column]
) -> DataFrame:
    columns = [c for c in old.columns if c not in on]
    a = old.select(*on, *[F.col(c).alias(f"_o_{c}") for c in columns])
    b = new.select(*on, *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_new"))
    arrived = F.coalesce(F.col("_new"), F.lit(False))
    return a.join(b, list(on), "full").select(
        *on, *[rule(c, F.col(f"_o_{c}"), F.col(f"_n_{c}"), arrived).alias(c) for c in columns]
    )


def _folded(
    old: DataFrame, new: DataFrame, on: Sequence[str], order: Sequence[str], value: Callable[[str, Column], Column]
) -> DataFrame:
    """One row a key; ``value`` is a column's aggregate, given the rows' place. Grouped as the merge
    joins, so it moves no row a second time."""
    rest = [c for c in old.columns if c not in on]
    place = F.struct(*(order or rest))
    return new.groupBy(*on).agg(*[value(c, place).alias(c) for c in rest]).select(*old.columns)


def _last(c: str, place: Column) -> Column:
    return F.max_by(F.struct(c), place)[c]


def upsert_overwrite(old: DataFrame, new: DataFrame, on: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """A new row replaces every non-key column, NULLs included."""
    new = _folded(old, new, on, order, _last)
    return _merge(old, new, on, lambda c, o, n, arrived: F.when(arrived, n).otherwise(o))


def upsert_keep_nonnull(old: DataFrame, new: DataFrame, on: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """A NULL in the new row keeps the old value."""
    new = _folded(old, new, on, order, lambda c, place: F.max_by(c, F.when(F.col(c).isNotNull(), place)))
    return _merge(old, new, on, lambda c, o, n, arrived: F.coalesce(n, o))


def upsert_zero_as_null(
    old: DataFrame, new: DataFrame, on: Sequence[str], cols: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """For ``cols`` a NULL or 0 keeps the old value of an existing row; the rest overwrite."""

    def last(c: str, place: Column) -> Column:
        if c not in cols:
            return _last(c, place)
        known = F.max_by(c, F.when(F.col(c) != 0, place))
        return F.coalesce(known, F.min_by(F.struct(c), place)[c])

    new = _folded(old, new, on, order, last)
    existing = "_old"
    marked = old.withColumn(existing, F.lit(True))

    def rule(c: str, o: Column, n: Column, arrived: Column) -> Column:
        known = F.coalesce(F.col(f"_o_{existing}"), F.lit(False))
        if c in cols:
            return F.when(arrived & known, F.coalesce(F.nullif(n, F.lit(0)), o)).when(arrived, n).otherwise(o)
        return F.when(arrived, n).otherwise(o)

    return _merge(marked, new.withColumn(existing, F.lit(True)), on, rule).drop(existing)


def replace_time_range(
    old: DataFrame, new: DataFrame, time: str, spans: DataFrame, keys: Keys = SUBJECT
) -> DataFrame:
    """Delete old rows inside any closed [start, end] span, then append the new rows."""
    kept = flag_inside(old, spans, time, "start", "end", keys, closed_end=True).where(~F.col("inside")).drop("inside")
    return kept.unionByName(new)


def retention_filter(df: DataFrame, time: str, days: int = 90, as_of=None) -> DataFrame:
    """Rows not older than ``days`` before ``as_of`` (now by default)."""
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    return df.where(F.col(time) >= now - F.make_dt_interval(F.lit(days)))


def append_run_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition: Sequence[str]) -> None:
    """Replace only the partitions present in ``df``. The rebalance hint clusters rows by
    partition and lets AQE split a large one, so no single task writes a whole hot day."""
    (
        df.hint("rebalance", *[F.col(c) for c in partition])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition)
        .parquet(path)
    )
