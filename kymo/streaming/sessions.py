"""Sleep sessions over a stream by the batch rule: a stage opens a session when it starts more than the
gap after the end of the stage before it.

The rule looks at the previous row only, so rows must be taken in order: a row waits in list state until
the watermark has passed it. Calls to the state store cost far more than rows, so keys are dealt to buckets
by hash and a bucket keeps its waiting rows and open sessions in Arrow blocks. An event-time timer wakes a
bucket for its next waiting row or the next end of an open session; the state of a bucket without either is
gone.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from kymo.core import SUBJECT, Keys, epoch_us

SETTING = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which keyed state with timers needs; the
    session's own provider is set again afterwards."""
    before = spark.conf.get(SETTING, None)
    spark.conf.set(SETTING, PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SETTING)
        else:
            spark.conf.set(SETTING, before)


def _longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


BLOCK = T.StructType([T.StructField("rows", T.BinaryType())])
WAITING, OPEN = ["key", "at", "tie", "seconds"], ["key", "start", "end", "n_stages", "seconds"]


def _up_ms(us: int) -> int:
    return -(-us // 1000)


def _packed(rows: pd.DataFrame) -> tuple[bytes]:
    sink = pa.BufferOutputStream()
    columns = {c: pa.array(rows[c].to_numpy(), pa.string() if c == "key" else pa.int64()) for c in rows.columns}
    table = pa.table(columns | {"key": columns["key"].dictionary_encode()})
    with pa.ipc.new_stream(sink, table.schema) as to:
        to.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(blocks, columns: list[str]) -> pd.DataFrame:
    read = [pa.ipc.open_stream(bytes(b)).read_all() for (b,) in blocks]
    parts = [t.set_column(0, "key", t["key"].cast(pa.string())) for t in read]
    return pa.concat_tables(parts).to_pandas() if parts else pd.DataFrame({c: [] for c in columns}).astype(dict.fromkeys(columns[1:], "int64"))


def advance(due: pd.DataFrame, now: pd.DataFrame, mark: int, gap: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(closed, open) sessions after the due rows of many keys, going on from their open sessions ``now``."""
    key = np.concatenate([now["key"].to_numpy(object), due["key"].to_numpy(object)])
    code = pd.factorize(key)[0]
    kind = np.repeat([0, 1], [len(now), len(due)])  # an open session comes before its key's rows
    tie = np.concatenate([np.zeros(len(now), "int64"), due["tie"].to_numpy()])
    start = np.concatenate([now["start"].to_numpy(), due["at"].to_numpy()])
    end = np.concatenate([now["end"].to_numpy(), (due["at"] + due["seconds"] * 1_000_000).to_numpy()])
    n = np.concatenate([now["n_stages"].to_numpy(), np.ones(len(due), "int64")])
    seconds = np.concatenate([now["seconds"].to_numpy(), due["seconds"].to_numpy()])
    order = np.lexsort((seconds, tie, start, kind, code))
    key, code, start, end, n, seconds = (x[order] for x in (key, code, start, end, n, seconds))
    opens = np.ones(len(code), bool)
    opens[1:] = (code[1:] != code[:-1]) | (start[1:] - end[:-1] > gap)
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(code)) - 1
    out = pd.DataFrame(
        {"key": key[first], "start": start[first], "end": end[last], "n_stages": np.add.reduceat(n, first), "seconds": np.add.reduceat(seconds, first)}
    )
    followed = np.append(code[first[1:]] == code[first[:-1]], False)
    closed = followed | (mark - out["end"].to_numpy() >= gap)  # any further row starts later than the mark
    return out[closed], out[~closed]


class PreviousRowSessions(StatefulProcessor):
    """Waiting rows and open sessions of the keys of one bucket; times are microseconds."""

    def __init__(self, gap_seconds: int):
        self.gap = gap_seconds * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", BLOCK)
        self.open = handle.getValueState("open", BLOCK)
        self.next = handle.getValueState("next", _longs("ms"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        named = {f"waiting_{c}": c for c in WAITING}
        blocks, first = [], []
        for part in rows:
            if not part.empty:
                blocks.append(_packed(part[list(named)].rename(columns=named)))
                first.append(int(part["waiting_at"].min()))
        if blocks:
            self.waiting.appendList(blocks)
            self._wake(min(first))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = _unpacked(self.waiting.get() if self.waiting.exists() else (), WAITING)
        now = _unpacked([self.open.get()] if self.open.exists() else (), OPEN)
        due = rows["at"] <= mark
        closed, now = advance(rows[due], now, mark, self.gap) if len(now) or due.any() else (now, now)
        self._keep(now, rows[~due])
        if len(closed):
            yield closed

    def _keep(self, now: pd.DataFrame, later: pd.DataFrame) -> None:
        self.next.clear()
        if len(now):
            self.open.update(_packed(now))
            self._wake(int(now["end"].min()) + self.gap)
        else:
            self.open.clear()
        if len(later):
            self.waiting.put([_packed(later)])
            self._wake(int(later["at"].min()))
        else:
            self.waiting.clear()

    def _wake(self, us: int) -> None:
        """One timer a bucket, the earliest."""
        at = _up_ms(us)
        known = self.next.get()[0] if self.next.exists() else None
        if known is None or at < known:
            if known is not None:
                self.handle.deleteTimer(known)
            self.handle.registerTimer(at)
            self.next.update((at,))

    def close(self) -> None:
        pass


def _text(name: str, kind: T.DataType) -> Column:
    """A key as a text that ``_value`` reads back exactly."""
    if not isinstance(kind, T.AtomicType):
        raise ValueError(f"key {name!r} must be of an atomic type, got {kind.simpleString()}")
    c = F.col(name)
    if isinstance(kind, T.TimestampType):
        c = F.unix_micros(c)
    elif isinstance(kind, T.BinaryType):
        return F.base64(c)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0).cast(kind)  # -0.0 is 0.0, as in any grouping
    return c.cast("string")


def _value(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(text.cast("long"))
    return F.unbase64(text) if isinstance(kind, T.BinaryType) else text.cast(kind)


def stream_ordered_sessions(
    sdf: DataFrame, keys: Keys = SUBJECT, watermark: str = "1 hour", gap_seconds: int = 1800, t: str = "time",
    tie: str = "event_id", buckets: int = 1024,
) -> DataFrame:
    """Sessions of ``gap_sessionize`` over a stream of (keys, time, seconds, tie), emitted once closed.
    Start the query inside ``rocksdb``.

    ``end`` is the end of the session's last stage. Equal starts are taken in order of ``tie``, a whole
    number; rows without time or seconds are dropped, rows behind the watermark too. Keys are of atomic
    types. State is bounded by the rows within the watermark; a task holds those of one of ``buckets``
    (rows of all keys / ``buckets``, and all rows of a key). A checkpoint keeps to its number of buckets.
    """
    keys = list(keys)
    kinds = [sdf.schema[k].dataType for k in keys]
    shape = T.StructType([T.StructField("key", T.StringType()), *_longs("start", "end", "n_stages", "seconds").fields])
    source = (
        sdf.where(F.col(t).isNotNull() & F.col("seconds").isNotNull())
        .withWatermark(t, watermark)
        .select(
            F.to_json(F.array(*[_text(k, kind) for k, kind in zip(keys, kinds)])).alias("waiting_key"),
            t, epoch_us(t).alias("waiting_at"), F.coalesce(F.col(tie).cast("long"), F.lit(0)).alias("waiting_tie"),
            F.col("seconds").cast("long").alias("waiting_seconds"),
        )
        .withColumn("waiting_bucket", F.pmod(F.xxhash64("waiting_key"), F.lit(buckets)))
    )
    out = source.groupBy("waiting_bucket").transformWithStateInPandas(
        PreviousRowSessions(gap_seconds), outputStructType=shape, outputMode="Append", timeMode="EventTime"
    )
    out = out.withColumn("key", F.from_json("key", "array<string>"))
    return out.select(
        *[_value(F.col("key")[i], kind).alias(k) for i, (k, kind) in enumerate(zip(keys, kinds))],
        F.timestamp_micros("start").alias("start"), F.timestamp_micros("end").alias("end"), "n_stages", "seconds",
    )
