"""Streamed sessions against the batch operator: nested intervals, ties, restarts."""

import datetime as dt
import random
import types

import pandas as pd
from pyspark.sql import functions as F

from kymo.operators import intervals as iv
from kymo.streaming import runs, sessions

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "subject_id int, time timestamp, seconds int, event_id int"


def _batch(spark, df):
    s = df.withColumn("end", F.expr("timestampadd(SECOND, seconds, time)"))
    got = iv.gap_sessionize(s, "time", "end", tie=["event_id"]).groupBy("subject_id", "session_no").agg(
        F.min("time").alias("start"), F.max_by("end", F.struct("time", "event_id")).alias("end"),
        F.count("*").alias("n_stages"), F.sum("seconds").alias("seconds"),
    )
    return sorted(tuple(r) for r in got.drop("session_no").collect())


def test_sessions_equal_the_batch_rule_over_restarts(spark, tmp_path):
    draw = random.Random(11)
    rows = []
    for s in (1, 2, 3):
        t = 0
        for i in range(60):
            t += draw.choice([0, 60, 600, 1900, 4000, 7300])
            # A long stage followed by short ones inside it: the next gap counts from the short one.
            rows.append((s, T0 + dt.timedelta(seconds=t), draw.choice([30, 300, 1700, 9000]), s * 1000 + i))
    rows.sort(key=lambda r: r[1])
    cut = len(rows) // 3
    parts = [rows[i * cut : (i + 1) * cut if i < 2 else None] for i in range(3)]
    # Within the watermark, rows come in any order.
    parts[1][:4], parts[1][4:8] = parts[1][4:8], parts[1][:4]
    far = (9, T0 + dt.timedelta(days=400), 60, 1)
    for i, part in enumerate([*parts, [far]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        # Each call starts the stream anew from its checkpoint.
        sdf = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        out = sessions.stream_ordered_sessions(sdf, watermark="1 hour")
        with sessions.rocksdb(spark):
            runs.run_append(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.conf.get(sessions.SETTING, None) != sessions.PROVIDER
    got = spark.read.parquet(str(tmp_path / "out"))
    got = sorted(tuple(r) for r in got.select("subject_id", "start", "end", "n_stages", "seconds").collect())
    assert got == _batch(spark, spark.createDataFrame(rows, SCHEMA)) and len(got) > 30


class _Cell:
    """A state variable that counts its calls."""

    def __init__(self):
        self.value, self.calls = None, 0

    def _set(self, value):
        self.calls, self.value = self.calls + 1, value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    update = put = _set
    appendList = lambda self, values: self._set([*(self.value or []), *values])
    clear = lambda self: self._set(None)


class _Handle:
    def __init__(self):
        self.cells, self.timers = [], set()

    def getListState(self, name, schema):
        self.cells.append(_Cell())
        return self.cells[-1]

    getValueState = getListState

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


def test_state_calls_do_not_grow_with_keys():
    processor, handle = sessions.PreviousRowSessions(1800), _Handle()
    processor.init(handle)
    n, us = 2000, 1_000_000
    rows = pd.DataFrame({"waiting_key": [f'["{k % n}"]' for k in range(3 * n)], "waiting_tie": range(3 * n), "waiting_seconds": 60})
    rows["waiting_at"] = [(0, 600, 5000)[k // n] * us for k in range(3 * n)]
    assert list(processor.handleInputRows((0,), iter([rows[:n], rows[n:]]), None)) == []
    out = []
    for mark in (4000, 5000, 10_000):  # sessions of two stages close, the third waits, opens and closes
        clock = types.SimpleNamespace(getCurrentWatermarkInMs=lambda m=mark: m * 1000)
        assert len(handle.timers) == 1 and min(handle.timers) <= mark * 1000
        handle.timers.clear()
        out.append([tuple(r) for part in processor.handleExpiredTimer((0,), clock, None) for r in part.itertuples(index=False)])
    texts = sorted(f'["{k}"]' for k in range(n))
    assert sorted(out[0]) == [(k, 0, 660 * us, 2, 120) for k in texts] and out[1] == []
    assert sorted(out[2]) == [(k, 5000 * us, 5060 * us, 1, 60) for k in texts]
    assert not handle.timers and sum(c.calls for c in handle.cells) < 60


def test_keys_of_several_types_share_buckets(spark, tmp_path):
    draw = random.Random(5)
    rows = []
    for i in range(400):
        who = draw.choice([None, 'a"b', "", "null", "é\n"])
        at = draw.choice([None, T0 + dt.timedelta(microseconds=1), T0 + dt.timedelta(days=9)])
        rows.append((who, at, T0 + dt.timedelta(seconds=draw.randrange(200_000)), draw.choice([30, 300, 1700, 9000]), i))
    schema = "_who string, at timestamp, time timestamp, seconds int, event_id int"
    far = ("z", None, T0 + dt.timedelta(days=400), 60, 1000)
    spark.createDataFrame([*rows, far], schema).write.parquet(str(tmp_path / "in"))
    sdf = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    keys = ["_who", "at"]
    with sessions.rocksdb(spark):
        runs.run_append(sessions.stream_ordered_sessions(sdf, keys, buckets=3), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*keys, "start", "end", "n_stages", "seconds").collect()]
    want, now = [], {}
    for who, at, t, seconds, _ in sorted(rows, key=lambda r: (r[2], r[4])):
        end, was = t + dt.timedelta(seconds=seconds), now.get((who, at))
        if was and t - was[1] <= dt.timedelta(minutes=30):
            now[who, at] = (was[0], end, was[2] + 1, was[3] + seconds)
        else:
            want += [(who, at, *was)] if was else []
            now[who, at] = (t, end, 1, seconds)
    want += [(*key, *last) for key, last in now.items()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 100
