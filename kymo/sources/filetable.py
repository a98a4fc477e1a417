"""Parquet tables whose changes rewrite only the files that hold touched rows.

A table is a folder of data files and one of manifests. A manifest lists the files of one version and
is written beside its place, then renamed to its number, which fails if that number is taken: readers
see the version before or the one after, a crash before the rename leaves only files that no manifest
names, and of two writers that start from the same version one fails. Files are cut by ranges of the
key, so that one day's rows lie in few of them and the footers' smallest and largest keys spare the
rest. Lists of files pass through the driver, as in any scan; rows do not.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kymo.core import SUBJECT, Keys
from kymo.operators.intervals import flag_inside
from kymo.session import materialized

Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class FileTable:
    """``key`` orders the rows in files; its values may be NULL, its types must be orderable."""

    path: str
    schema: T.StructType
    key: tuple[str, ...]


def _hadoop(spark: SparkSession, path: str):
    fs = spark._jvm.org.apache.hadoop.fs
    where = fs.Path(path)
    return fs, where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, table: FileTable) -> list[int]:
    """Numbers of the committed versions, ascending."""
    _, where, system = _hadoop(spark, f"{table.path}/manifests")
    names = [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []
    return sorted(int(n) for n in names if n.isdigit())


def files(spark: SparkSession, table: FileTable, version: int | None = None) -> list[str]:
    """The files of a version (the last one by default) as folder/name."""
    known = versions(spark, table)
    if not known:
        return []
    rows = spark.read.schema("value string").text(f"{table.path}/manifests/{known[-1] if version is None else version:012d}")
    return sorted(r.value for r in rows.collect())


def commit(spark: SparkSession, table: FileTable, names: Sequence[str], version: int) -> None:
    """Make ``names`` the files of ``version``; an error if that version exists."""
    fs, beside, _ = _hadoop(spark, f"{table.path}/manifests/_{uuid.uuid4().hex}")
    # sorted and in one file: manifests of the same files are the same bytes
    spark.createDataFrame([(n,) for n in sorted(names)], "value string").coalesce(1).write.text(beside.toString())
    context = fs.FileContext.getFileContext(beside.toUri(), spark._jsc.hadoopConfiguration())
    never_over = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context.rename(beside, fs.Path(f"{table.path}/manifests/{version:012d}"), never_over)


def _next(spark: SparkSession, table: FileTable) -> tuple[int, list[str]]:
    known = versions(spark, table)
    return (known[-1] + 1, files(spark, table, known[-1])) if known else (0, [])


def short_name(path: Column) -> Column:
    """folder/name of a file's path."""
    return F.substring_index(path, "/", -2)


def open_files(spark: SparkSession, table: FileTable, names: Sequence[str]) -> DataFrame:
    if not names:
        return spark.createDataFrame([], table.schema)
    return spark.read.schema(table.schema).parquet(*[f"{table.path}/data/{n}" for n in names])


def read_table(spark: SparkSession, table: FileTable, version: int | None = None) -> DataFrame:
    return open_files(spark, table, files(spark, table, version))


def new_folder(prefix: str = "") -> str:
    return f"{prefix}{uuid.uuid4().hex}"


def write_files(df: DataFrame, table: FileTable, folder: str | None = None) -> list[str]:
    """Write rows as files cut by ranges of the key and sorted by it; their names. AQE sizes them."""
    folder = folder or new_folder()
    path = f"{table.path}/data/{folder}"
    typed = df.select(*[F.col(f.name).cast(f.dataType) for f in table.schema])
    typed.repartitionByRange(*table.key).sortWithinPartitions(*table.key).write.parquet(path)
    written = df.sparkSession.read.schema(table.schema).parquet(path).inputFiles()
    return [f"{folder}/{f.rsplit('/', 1)[1]}" for f in written]


def create_table(df: DataFrame, path: str, key: Sequence[str]) -> FileTable:
    """Version 0 of a new table; an error if there is one at ``path``."""
    table = FileTable(path, df.schema, tuple(key))
    commit(df.sparkSession, table, write_files(df, table), 0)
    return table


def _within(rows: DataFrame, columns: Sequence[str]) -> Column | None:
    """Smallest to largest value of ``rows`` in each column: filters that reach the footers."""
    ends = rows.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)]).first()
    if any(ends[f"min_{c}"] is None for c in columns):
        return None
    typed = lambda kind, c: F.lit(ends[f"{kind}_{c}"]).cast(rows.schema[c].dataType)
    return reduce(Column.__and__, [F.col(c).between(typed("min", c), typed("max", c)) for c in columns])


def _names_of(rows: DataFrame) -> list[str]:
    return [r.name for r in rows.select("name").distinct().collect()]


def holding_keys(spark: SparkSession, table: FileTable, names: Sequence[str], keys: DataFrame, on: Sequence[str]) -> list[str]:
    """Those of ``names`` that hold a key of ``keys``. Only key columns are read, and of these only
    row groups between the smallest and the largest key; NULL keys are held by no file."""
    near = _within(keys, on)
    if near is None or not names:
        return []
    held = open_files(spark, table, names).where(near).select(*on, short_name(F.col("_metadata.file_path")).alias("name"))
    return _names_of(held.join(keys.select(*on).distinct(), list(on), "left_semi"))


def upsert_files(spark: SparkSession, table: FileTable, new: DataFrame, on: Sequence[str], merge: Merge) -> list[str]:
    """Bring ``new`` into the table; the names of the files that were replaced.

    ``merge(old, new)`` gives the merged rows, as ``sinks.upsert_overwrite`` and its kin do; it only gets
    the old rows of files that hold a key of ``new``. Rows of ``new`` without a match are appended,
    those with a NULL key among them; an empty ``new`` makes no version.
    """
    version, names = _next(spark, table)
    new = materialized(new, "upsert")
    if new.isEmpty():
        return []
    touched = holding_keys(spark, table, names, new, on)
    written = write_files(merge(open_files(spark, table, touched), new), table)
    commit(spark, table, [n for n in names if n not in set(touched)] + written, version)
    return touched


def replace_range_files(
    spark: SparkSession, table: FileTable, new: DataFrame, time: str, spans: DataFrame, keys: Keys = SUBJECT
) -> list[str]:
    """Delete the table's rows inside any closed [start, end] span, then append ``new``; the names of
    the files that were replaced. Files without such a row stay as they are."""
    version, names = _next(spark, table)
    spans = materialized(spans.where("start <= end"), "spans")
    touched = []
    ends = spans.agg(F.min("start").alias("low"), F.max("end").alias("high")).first()
    if ends.low is not None and names:
        near = open_files(spark, table, names).where(F.col(time).between(F.lit(ends.low), F.lit(ends.high)))
        held = near.select(*keys, time, short_name(F.col("_metadata.file_path")).alias("name")).distinct()
        touched = _names_of(flag_inside(held, spans, time, "start", "end", keys, closed_end=True).where("inside"))
    kept = flag_inside(open_files(spark, table, touched), spans, time, "start", "end", keys, closed_end=True)
    rows = kept.where("NOT inside").drop("inside").unionByName(new)
    left = set(names) - set(touched)
    commit(spark, table, [*left, *write_files(rows, table)], version)
    return touched


def drop_unnamed(spark: SparkSession, table: FileTable, keep: int = 2) -> int:
    """Delete manifests before the last ``keep`` and every data file that none of these names; how many
    files went. Not while a writer is at work: its files are not named yet."""
    known = versions(spark, table)
    named = {n for v in known[-keep:] for n in files(spark, table, v)}
    fs, where, system = _hadoop(spark, f"{table.path}/data")
    gone = 0
    for folder in system.listStatus(where):
        of = folder.getPath().getName()
        left = [s.getPath() for s in system.listStatus(folder.getPath()) if s.getPath().getName().startswith("part-")]
        stay = [p for p in left if f"{of}/{p.getName()}" in named]
        gone += len(left) - len(stay)
        for p in left if stay else [folder.getPath()]:
            if p not in stay:
                system.delete(p, True)
    for v in known[:-keep]:
        system.delete(fs.Path(f"{table.path}/manifests/{v:012d}"), True)
    return gone
