"""Repeated byte strings over a corpus, from merged Burrows-Wheeler transforms of its shards.

Suffixes are sampled: of every ``w`` neighbouring places the one with the smallest hash of its next
eight bytes is an anchor, so equal strings have equal anchors, and every string of ``length`` bytes
has one whose choice depends on that string alone. A suffix is read in symbols of fixed length from
its anchor; the bytes before the anchor are the symbol of the transform's column.

Documents whose whole text an earlier one has are repeats as a whole and take no further part.

1. Each shard sorts the suffixes of its anchors by their symbols: its transform, cut into slices by
   the first symbol. Of rows that agree one goes on, so that a string however frequent is one row a
   shard. Slices of equal range meet in one task.
2. A task merges its slices by interleave refinement. The interleaving by the first symbol gives
   blocks of suffixes with a common prefix; each round splits the blocks of more than one suffix by
   the next symbol, and last by the preceding one. Slices are sorted, so a round merges runs and
   sorts no suffix anew, and blocks of one suffix drop out. What is left are the repeated intervals.
3. Each repeated anchor stands for the strings around it of which it is the first anchor that they
   determine. Anchors with equal surroundings are one row; the earliest stays and the strings of the
   others are repeats. Where surroundings differ but the interval is the same, at the edges of
   repeats, the strings of the earliest copies are compared one by one.

A repeat is a string of ``length`` bytes that also starts earlier: in a document with a smaller id, or
in the same one at an earlier place. All bytes that repeats cover are removed; overlaps count, and
strings are judged on the input. Strings are compared by 128-bit hashes.

Defined cases: a NULL text is empty; texts shorter than ``length`` keep all bytes; documents without an
id come last; documents that share an id are ordered by the hash of their text, and rows that share
both are one document and come out alike; an empty table gives an empty result; ids must be integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.llm.frames import bounded, discard, give_back, released, small
from kymo.session import materialized

GRAM = 8
#: Bits of the first symbol, the second, and the preceding one in a packed row.
FIRST, SECOND, BEFORE = 28, 18, 18
#: Text of one shard, and text behind one range of the merged order.
SHARD_BYTES, RANGE_BYTES = 32 << 20, 32 << 20
LAST = (1 << 63) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Anchors:
    """Anchors of one text for strings of ``length`` bytes."""

    def __init__(self, raw: bytes, length: int):
        self.raw, self.length = raw, length
        self.reach = (length - GRAM) // 3  # places on each side that decide about an anchor
        self.places = np.zeros(0, np.int64)
        if len(raw) < length:
            return
        padded = raw + bytes(GRAM)
        self.grams = np.empty(len(raw), np.uint64)
        for k in range(GRAM):
            part = np.frombuffer(padded, "<u8", (len(raw) - k + GRAM - 1) // GRAM, k)
            self.grams[k::GRAM] = part
        code = self.grams[: len(raw) - GRAM + 1] * _MIX
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xD6E8FEB86659FD93)
        at = np.arange(len(code), dtype=np.uint64)
        least = (code & np.uint64(0xFFFFFFFF00000000)) | at  # the leftmost of equals
        width, have = self.reach + 1, 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        chosen = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.places = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])]

    def units(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each anchor that some string has as its first one beyond ``reach`` bytes: its place,
        and the first and last start of these strings."""
        b = self.places
        before = np.concatenate([[-1 - self.reach], b[:-1]])
        lo = np.maximum(before - self.reach + 1, 0)
        hi = np.minimum(b - self.reach, len(self.raw) - self.length)
        some = hi >= lo
        return b[some], lo[some], hi[some]

    def _symbol(self, starts: np.ndarray, size: int, bits: int) -> np.ndarray:
        """Hash of the ``size`` bytes from each start."""
        total = np.full(len(starts), size, np.uint64)
        for at in [*range(0, size - GRAM, GRAM), size - GRAM]:
            total = (total ^ self.grams[starts + at]) * _MIX
            total ^= total >> np.uint64(31)
        return total >> np.uint64(64 - bits) if bits < 64 else total

    def rows(self, b: np.ndarray) -> np.ndarray:
        """Packed rows of the transform: two symbols of the suffix, then the preceding one."""
        right = self.length - 2 * self.reach
        one = self._symbol(b, right // 2, FIRST)
        two = self._symbol(b + right // 2, right - right // 2, SECOND)
        preceding = self._symbol(b - self.reach, self.reach, BEFORE)
        return (one << np.uint64(SECOND + BEFORE)) | (two << np.uint64(BEFORE)) | preceding


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _transforms(length: int, bits: int):
    """Documents -> slices of their shard's transform: range, rows (sorted), owners, anchors."""

    def slices(rows, owners, ordinals):
        edges = np.searchsorted(rows >> np.uint64(64 - bits), np.arange((1 << bits) + 1)) if bits else [0, len(rows)]
        for r, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            if hi > lo:
                yield r, rows[lo:hi].tobytes(), owners[lo:hi], ordinals[lo:hi]

    def sliced(rows, owners, ordinals, ids):
        order = np.argsort(rows, kind="stable")
        rows, owners, ordinals = rows[order], owners[order], ordinals[order]
        same = rows[1:] == rows[:-1]
        first = np.concatenate([[True], ~same])
        repeated = ~first | np.concatenate([same, [False]])
        out = list(slices(rows[first], owners[first], ordinals[first]))
        if repeated.any():  # known already; only one row of each goes on to meet other shards
            out.append((-1 - int(ids[0]) % 4096, b"", owners[repeated], ordinals[repeated]))
        named = [np.unique(o, return_inverse=True) for _, _, o, _ in out]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([c[0] for c in out], pa.int32()),
                pa.array([c[1] for c in out], pa.binary()),
                pa.array([ids[n].tobytes() for n, _ in named], pa.binary()),
                pa.array([i.astype("<u4").tobytes() for _, i in named], pa.binary()),
                pa.array([c[3].astype("<u4").tobytes() for c in out], pa.binary()),
            ],
            ["range", "rows", "ids", "owners", "anchors"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, owners, ordinals, ids, held = [], [], [], [], 0
        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = Anchors(_bytes(text), length)
                b, _, _ = found.units()
                if not len(b):
                    continue
                rows.append(found.rows(b))
                owners.append(np.full(len(b), len(ids), np.int64))
                ordinals.append(np.arange(len(b)))
                ids.append(i)
                held += len(found.raw)
                if held >= SHARD_BYTES:
                    yield sliced(*map(np.concatenate, (rows, owners, ordinals)), np.array(ids, np.int64))
                    rows, owners, ordinals, ids, held = [], [], [], [], 0
        if ids:
            yield sliced(*map(np.concatenate, (rows, owners, ordinals)), np.array(ids, np.int64))

    return run


def interleave(slices: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted slices of packed rows by interleave refinement.

    Gives for each row (slices one after the other) whether it is in a repeated interval, and how
    many symbols its longest common prefix with another row has.
    """
    rows = np.concatenate(slices)
    live = np.arange(len(rows))  # rows in blocks of more than one, in merged order
    block = np.zeros(len(rows), np.int64)
    prefix = np.zeros(len(rows), np.int8)
    for depth, (shift, bits) in enumerate(((SECOND + BEFORE, FIRST), (BEFORE, SECOND), (0, BEFORE))):
        symbol = (rows[live] >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        # runs of each slice are in order within a block, so this stable sort only merges runs
        place = np.argsort((block.astype(np.uint64) << np.uint64(bits)) | symbol, kind="stable")
        live, block, symbol = live[place], block[place], symbol[place]
        if not len(live):
            break
        new = np.concatenate([[True], (block[1:] != block[:-1]) | (symbol[1:] != symbol[:-1])])
        block = np.cumsum(new) - 1
        more = (np.bincount(block) > 1)[block]
        live = live[more]
        block = np.cumsum(np.concatenate([[0], np.diff(block[more]) != 0])) if more.any() else block[more]
        if depth < 2:
            prefix[live] = depth + 1
    repeated = np.zeros(len(rows), bool)
    repeated[live] = True
    return repeated, prefix


def _merged(table: pa.Table) -> pa.Table:
    """The slices of one range -> documents with the numbers of their repeated anchors."""
    slices = [np.frombuffer(x, np.uint64) for x in table.column("rows").to_pylist()]
    repeated, _ = interleave(slices)
    ids, anchors, at = [np.zeros(0, np.int64)], [], 0
    for s, names, owners, ordinals in zip(slices, *(table.column(c).to_pylist() for c in ("ids", "owners", "anchors")), strict=True):
        owner, ordinal = np.frombuffer(owners, "<u4"), np.frombuffer(ordinals, "<u4")
        if len(s):  # without rows: repeated in its own shard
            owner, ordinal = owner[repeated[at : at + len(s)]], ordinal[repeated[at : at + len(s)]]
        at += len(s)
        order = np.argsort(owner, kind="stable")
        owner, ordinal = owner[order], ordinal[order]
        cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else []
        ids.append(np.frombuffer(names, np.int64)[owner[cut]])
        anchors += [x.tobytes() for x in np.split(ordinal, cut[1:])] if len(owner) else []
    found = pa.table([pa.array(np.concatenate(ids)), pa.array(anchors, pa.binary())], names=["id", "anchors"])
    del slices, repeated, ids, anchors
    give_back()
    return found


def _hash(raw: bytes, starts, ends) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of the byte ranges, as two longs."""
    code = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[s:e]) for s, e in zip(starts, ends, strict=True)]), np.int64)
    return code[::2], code[1::2]


def _units(length: int):
    """Documents with their repeated anchors -> a row for each: hash of its surroundings, the
    transform's row, and the strings it stands for, as first start and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                parts = []
                for i, h, text, lists in zip(*(some.column(c).to_pylist() for c in ("id", "hash", "text", "anchors")), strict=True):
                    found = Anchors(_bytes(text), length)
                    b, lo, hi = found.units()
                    yes = np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in lists]).astype(np.int64))
                    yes = yes[yes < len(b)]  # documents that share an id
                    b, lo, hi = b[yes], lo[yes], hi[yes]
                    if not len(b):
                        continue
                    one, two = _hash(found.raw, lo.tolist(), (hi + length).tolist())
                    two = two ^ (b - lo) ^ ((hi - lo) << 32)  # where the anchor lies, and how many strings
                    parts.append((np.full(len(b), i), np.full(len(b), h), one, two, found.rows(b).view(np.int64), lo, hi - lo + 1))
                if parts:
                    names = ["id", "hash", "one", "two", "row", "start", "n"]
                    columns = [np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True)]
                    kinds = [np.int32 if n in ("start", "n") else np.int64 for n in names]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _strings(length: int):
    """Documents with units at the edges of repeats -> hashes of the strings of these units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                parts = []
                for i, h, text, units in zip(*(some.column(c).to_pylist() for c in ("id", "hash", "text", "units")), strict=True):
                    raw = _bytes(text)
                    starts = np.unique(np.concatenate([np.arange(u["start"], u["start"] + u["n"]) for u in units]))
                    starts = starts[starts <= len(raw) - length]
                    if not len(starts):
                        continue
                    one, two = _hash(raw, starts.tolist(), (starts + length).tolist())
                    parts.append((np.full(len(starts), i), np.full(len(starts), h), one, two, starts))
                if parts:
                    columns = [np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True)]
                    columns[-1] = columns[-1].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "hash", "one", "two", "start"])

    return run


def _covered(length: int):
    """Runs of starts of repeats in a document -> the byte spans that they cover, merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for runs in batch.column("runs").to_pylist():
                s = np.array([r["start"] for r in runs], np.int64)
                e = s + np.array([r["n"] for r in runs], np.int64) + (length - 1)
                order = np.argsort(s, kind="stable")
                s, e = s[order], np.maximum.accumulate(e[order])
                new = np.concatenate([[True], s[1:] > e[:-1]])
                ends = e[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(e) - 1]])]
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(s[new], ends, strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hash"), pa.array(spans, kind)], ["id", "hash", "spans"])

    return run


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} must hold integers, not {kind}")
    return docs.select(
        F.col(id_col).alias("given"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text")
    )


def repeated_spans(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Byte spans of ``docs`` that repeats cover: id (NULL ids as the largest long), hash of the
    text, spans. Documents without repeats are left out."""
    if length < 50:
        raise ValueError("length must be at least 50 bytes")
    every = _named(docs, id_col, text_col)
    gone = _copies(every, length)
    rows = every.join(small(gone.select("id", "hash")), ["id", "hash"], "left_anti")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(0, (total // RANGE_BYTES).bit_length()), FIRST)
    slices = rows.select("id", "text").mapInArrow(
        released(_transforms(length, bits)), "range int, rows binary, ids binary, owners binary, anchors binary"
    )
    marked = slices.groupBy("range").applyInArrow(_merged, "id long, anchors binary")
    marked = materialized(marked.groupBy("id").agg(F.collect_list("anchors").alias("anchors")), "repeated-anchors")
    marks = bounded(marked, "aggregate(anchors, 0L, (a, x) -> a + octet_length(x))")
    units = materialized(
        rows.join(marks, "id").mapInArrow(
            released(_units(length)), "id long, hash long, one long, two long, row long, start int, n int"
        ),
        "units",
    )
    discard(marked)
    # of equal surroundings the earliest stays
    firsts = units.groupBy("one", "two").agg(
        F.min(F.struct("id", "hash", "start", "n")).alias("first"), F.min("row").alias("row"), F.count("*").alias("copies")
    )
    firsts = materialized(firsts, "first-units")
    copied = firsts.where("copies > 1").select("one", "two", F.struct("first.id", "first.hash", "first.start").alias("first"))
    later = units.drop("row").join(copied, ["one", "two"]).where(F.struct("id", "hash", "start") != F.col("first"))
    later = materialized(later.select("id", "hash", "start", "n"), "later-units")
    discard(units)
    # intervals with more than one kind of surroundings: compare the strings of the earliest copies
    edges = firsts.groupBy("row").agg(F.count("*").alias("kinds")).where("kinds > 1")
    edge = firsts.select("row", "first").join(edges, "row", "left_semi").select("first.*")
    edge = materialized(edge.groupBy("id", "hash").agg(F.collect_list(F.struct("start", "n")).alias("units")), "edge-units")
    discard(firsts)
    strings = rows.join(bounded(edge, "16 * size(units)"), ["id", "hash"]).mapInArrow(
        released(_strings(length)), "id long, hash long, one long, two long, start int"
    )
    strings = materialized(strings, "edge-strings")  # repeated rows repeat strings, but start where the first does
    discard(edge)
    known = strings.groupBy("one", "two").agg(F.min(F.struct("id", "hash", "start")).alias("first"), F.count("*").alias("copies"))
    again = strings.join(known.where("copies > 1").drop("copies"), ["one", "two"]).where(F.struct("id", "hash", "start") != F.col("first"))
    runs = later.unionByName(again.select("id", "hash", "start", F.lit(1).alias("n")))
    # a document's runs are bounded by its text
    by_doc = runs.groupBy("id", "hash").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    spans = by_doc.mapInArrow(released(_covered(length)), "id long, hash long, spans array<struct<start:long,end:long>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("bytes").cast("long").alias("end")))
    out = materialized(spans.unionByName(gone.select("id", "hash", whole.alias("spans"))), "spans")
    discard(gone, strings, later)
    return out


def _copies(rows: DataFrame, length: int) -> DataFrame:
    """Documents whose whole text an earlier one has: (id, hash, bytes). All their strings are
    repeats, and none of them is the earliest of its kind, so no other document needs them."""
    named = rows.select("id", "hash", F.md5(F.col("text").cast("binary")).alias("md5"), F.octet_length("text").alias("bytes"))
    named = materialized(named.where(F.col("bytes") >= length), "whole-texts")
    first = named.groupBy("md5", "bytes").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    first = first.where("copies > 1").select("md5", "bytes", "first")
    gone = named.join(first, ["md5", "bytes"]).where(F.col("id") > F.col("first"))
    out = materialized(gone.select("id", "hash", "bytes").distinct(), "copies")
    discard(named)
    return out


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            out = []
            for text, spans in zip(some.column("text").to_pylist(), some.column("spans").to_pylist(), strict=True):
                raw, done, kept = _bytes(text), 0, []
                for span in spans or ():
                    kept.append(raw[done : span["start"]])
                    done = span["end"]
                out.append(b"".join([*kept, raw[done:]]))
            columns = [c for c in some.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[some.column(c) for c in columns], pa.array(out, pa.binary())], [*columns, "kept"])


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, spans (removed byte spans, maximal), n_bytes, kept (the
    remaining bytes; a cut may fall inside a character)."""
    spans = repeated_spans(docs, length, id_col, text_col)
    rows = _named(docs, id_col, text_col)
    joined = rows.join(bounded(spans, "16 * size(spans)"), ["id", "hash"], "left")
    kind = docs.schema[id_col].dataType.simpleString()
    return (
        joined.select("given", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "spans")
        .mapInArrow(released(_kept), f"given {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
        .withColumnRenamed("given", id_col)
    )
