"""Tiered compaction: number of runs, equality with the fold, replays, crashes, a hot key."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kymo.sources import filetable as ft
from kymo.streaming import runs, tiers

SCHEMA = T.StructType().add("k", "integer").add("at", "integer").add("v", "integer")


def batch(spark, b, n=12):
    """Key 0 takes a third of the rows of every batch."""
    return spark.createDataFrame([((b * 5 + i) % 9 if i % 3 else 0, i, b * 100 + i) for i in range(n)], SCHEMA)


def kept(df):
    return sorted(tuple(r) for r in df.select("k", "at", "v").collect())


def test_runs_are_the_digits_of_the_batch_count():
    spans: list[tuple[int, int]] = []
    for b in range(1000):
        first = tiers.merged_from(b, 4)
        spans = [s for s in spans if s[0] < first] + [(first, b)]
        assert spans[0][0] == 0 and all(a[1] + 1 == c[0] for a, c in zip(spans, spans[1:]))
        digits, n = 0, b + 1
        while n:
            digits, n = digits + n % 4, n // 4
        assert len(spans) == digits <= 15  # three a tier, five tiers up to 1,023


def test_equal_to_the_fold_with_few_runs(spark, tmp_path):
    table = tiers.tiered_table(str(tmp_path / "t"), SCHEMA, ["k"])
    every = None
    for b in range(11):
        df = batch(spark, b)
        tiers.add_batch(df, table, b, ["at"], fan=3, keep=4)
        logged = df.withColumn(runs.BATCH, F.lit(b).cast("long"))
        every = logged if every is None else every.unionByName(logged)
    assert tiers.runs_of(spark, table) == [(0, 8), (9, 9), (10, 10)]
    assert kept(tiers.current(spark, table)) == kept(runs.current_rows(every, ["k"], ["at"]))
    # one row a key in each run, whatever the number of rows of a key
    assert ft.read_table(spark, table).groupBy("k").count().agg(F.max("count")).first()[0] <= 3
    assert len(ft.versions(spark, table)) <= 7
    before = ft.versions(spark, table)
    tiers.add_batch(batch(spark, 99), table, 10, ["at"], fan=3)  # a replay
    assert ft.versions(spark, table) == before


def test_a_crash_before_the_commit_is_repaired_by_the_replay(spark, tmp_path, monkeypatch):
    table = tiers.tiered_table(str(tmp_path / "t"), SCHEMA, ["k"])
    tiers.add_batch(batch(spark, 0), table, 0, ["at"], fan=2)
    before = kept(tiers.current(spark, table))

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(ft, "commit", crash)
        with pytest.raises(RuntimeError, match="lost"):
            tiers.add_batch(batch(spark, 1), table, 1, ["at"], fan=2)
    assert kept(tiers.current(spark, table)) == before
    tiers.add_batch(batch(spark, 1), table, 1, ["at"], fan=2)
    assert tiers.runs_of(spark, table) == [(0, 1)]
    both = [batch(spark, b).withColumn(runs.BATCH, F.lit(b).cast("long")) for b in (0, 1)]
    assert kept(tiers.current(spark, table)) == kept(runs.current_rows(both[0].unionByName(both[1]), ["k"], ["at"]))
