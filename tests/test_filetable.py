"""Upserts and range replacement that leave untouched files alone."""

import datetime as dt
import os

import pytest

from kymo.sources import filetable as ft
from kymo.sources import sinks

D0 = dt.date(2024, 1, 1)
T0 = dt.datetime(2024, 1, 1)
SCHEMA = "subject_id int, date date, a int, b int"
ON = ["date", "subject_id"]


def day(d, s=1, a=1, b=1):
    return (s, D0 + dt.timedelta(d), a, b)


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def stamps(table, names):
    return {n: os.stat(f"{table.path}/data/{n}").st_mtime_ns for n in names}


@pytest.fixture
def table(spark, tmp_path):
    """Forty days of two subjects in several files."""
    made = ft.create_table(frame(spark, [day(0)]), str(tmp_path / "t"), ON)
    parts = [frame(spark, [day(d, s) for d in range(lo, lo + 10) for s in (1, 2)]) for lo in (0, 10, 20, 30)]
    for part in parts:  # each decade has a file of its own
        ft.upsert_files(spark, made, part.coalesce(1), ON, lambda o, n: sinks.upsert_overwrite(o, n, ON))
    return made


def overwrite(o, n):
    return sinks.upsert_overwrite(o, n, ON)


def test_an_upsert_of_one_day_leaves_other_files_alone(spark, table):
    before = ft.files(spark, table)
    old = rows(ft.read_table(spark, table))
    kept = stamps(table, before)
    touched = ft.upsert_files(spark, table, frame(spark, [day(15, 1, 9, None), day(15, 3, 7, 7)]), ON, overwrite)
    assert touched and set(touched) < set(before)
    after = ft.files(spark, table)
    assert set(before) - set(after) == set(touched)
    stayed = set(before) & set(after)
    assert stayed and {n: kept[n] for n in stayed} == stamps(table, stayed)
    want = [r for r in old if r[:2] != day(15)[:2]] + [day(15, 1, 9, None), day(15, 3, 7, 7)]
    assert rows(ft.read_table(spark, table)) == sorted(want, key=str)
    assert rows(ft.read_table(spark, table, ft.versions(spark, table)[-2])) == old


def test_only_files_with_touched_keys_are_opened_whole(spark, table):
    seen = []

    def merge(o, n):
        seen.extend(o.inputFiles())
        return overwrite(o, n)

    touched = ft.upsert_files(spark, table, frame(spark, [day(35, 2, 5, 5)]), ON, merge)
    assert sorted("/".join(f.rsplit("/", 2)[1:]) for f in seen) == sorted(touched) and len(touched) == 1


def test_a_crash_before_the_commit_changes_nothing(spark, table, monkeypatch):
    before, names = rows(ft.read_table(spark, table)), ft.files(spark, table)

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(ft, "commit", crash)
        with pytest.raises(RuntimeError, match="lost"):
            ft.upsert_files(spark, table, frame(spark, [day(3, 1, 0, 0)]), ON, overwrite)
    assert ft.files(spark, table) == names and rows(ft.read_table(spark, table)) == before
    # its files go with those of old versions; nothing that is named goes
    assert ft.drop_unnamed(spark, table, keep=1) >= 1
    assert rows(ft.read_table(spark, table)) == before
    assert ft.drop_unnamed(spark, table, keep=1) == 0 and len(ft.versions(spark, table)) == 1


def test_of_two_writers_one_fails(spark, table):
    version = ft.versions(spark, table)[-1] + 1
    ft.upsert_files(spark, table, frame(spark, [day(3, 1, 0, 0)]), ON, overwrite)
    with pytest.raises(Exception, match="exist"):
        ft.commit(spark, table, [], version)
    assert ft.read_table(spark, table).count() == 80


def test_null_keys_new_keys_and_empty_batches(spark, table):
    n = len(ft.versions(spark, table))
    assert ft.upsert_files(spark, table, frame(spark, []), ON, overwrite) == []
    assert len(ft.versions(spark, table)) == n
    new = [(None, D0, 1, 1), (5, None, 2, 2), day(100, 1, 3, 3)]
    assert ft.upsert_files(spark, table, frame(spark, new), ON, overwrite) == []
    assert ft.upsert_files(spark, table, frame(spark, [(None, None, 1, 1)]), ON, overwrite) == []
    assert ft.read_table(spark, table).count() == 84


def test_repeated_keys_are_folded_in_order(spark):
    old = spark.createDataFrame([(1, 5, 6)], "k int, a int, b int")
    new = spark.createDataFrame(
        [(1, 0, 1, 1), (1, 8, None, 2), (1, None, None, 3), (2, 0, 1, 1), (2, None, 2, 2)], "k int, a int, b int, at int"
    )
    take = lambda df: sorted(map(tuple, df.collect()))
    assert take(sinks.upsert_overwrite(old, new, ["k"], ["at"])) == [(1, None, None), (2, None, 2)]
    assert take(sinks.upsert_keep_nonnull(old, new, ["k"], ["at"])) == [(1, 8, 1), (2, 0, 2)]
    assert take(sinks.upsert_zero_as_null(old, new, ["k"], ["a"], ["at"])) == [(1, 8, None), (2, 0, 2)]


def test_replaced_ranges_leave_other_files_alone(spark, tmp_path):
    kind = "subject_id int, time timestamp, v int"
    at = lambda h: T0 + dt.timedelta(hours=h)
    hours = lambda lo, hi: spark.createDataFrame([(1, at(h), 0) for h in range(lo, hi)], kind)
    none = spark.createDataFrame([], "subject_id int, start timestamp, end timestamp")
    table = ft.create_table(hours(0, 40), str(tmp_path / "r"), ["time", "subject_id"])
    assert ft.replace_range_files(spark, table, hours(40, 100), "time", none) == []
    before = ft.files(spark, table)
    assert len(before) > 1
    spans = spark.createDataFrame([(1, at(2), at(4)), (2, at(50), at(60))], "subject_id int, start timestamp, end timestamp")
    touched = ft.replace_range_files(spark, table, spark.createDataFrame([(1, at(3), 7)], kind), "time", spans)
    assert len(touched) == 1 and set(before) - set(ft.files(spark, table)) == set(touched)
    got = sorted((r.time, r.v) for r in ft.read_table(spark, table).collect())
    assert got == sorted([(at(h), 0) for h in range(100) if not 2 <= h <= 4] + [(at(3), 7)])
    assert ft.replace_range_files(spark, table, spark.createDataFrame([(3, at(3), 7)], kind), "time", none) == []
    assert ft.read_table(spark, table).count() == 99


def test_the_key_scan_reads_keys_and_pushes_their_range_down(spark, table, monkeypatch, capsys):
    monkeypatch.setattr(ft, "_names_of", lambda rows: rows.explain("formatted") or [])
    ft.holding_keys(spark, table, ft.files(spark, table), frame(spark, [day(15), day(16)]), ON)
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(date,2024-01-16)" in plan and "LessThanOrEqual(date,2024-01-17)" in plan
    assert "ReadSchema: struct<subject_id:int,date:date>" in plan
