"""Minimax contiguous partition of ordered atomic groups.

Documents with equal text form one atomic group; groups are ordered by the hash of their text. The
smallest feasible shard capacity is found by binary search, each capacity checked greedily, and the
order is cut there.

The driver never sees the groups. It holds sizes of key ranges: a range that a check cuts through
is split further until all cuts fall between groups. As long as a range is whole it counts as
divisible, so a capacity that fails is infeasible for the groups as well, and one whose cuts fall
on group ends is feasible: the capacity found is exact.

Defined cases: a NULL text counts as empty (size 8, with the empty texts as its group), two texts
whose 64-bit hashes agree share a group, repeated rows are rows like others, an empty table gives
an empty result, fewer groups than shards leave shards empty.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kymo.session import materialized

#: A range holds the keys whose upper bits agree: 52 bits below at first, 6 fewer at each look.
FIRST_BITS, STEP = 52, 6
PER_ROW = 8


@dataclass(frozen=True)
class Range:
    """Groups with key >> bits == slice: total bytes, largest group, atomic if it is one group."""

    slice: int
    bits: int
    size: int
    largest: int
    atomic: bool

    @property
    def start(self) -> int:
        return self.slice << self.bits


def _look(groups: DataFrame, ranges: list[Range] | None = None) -> list[Range]:
    """Sizes of all ranges of the first look, or of the parts of ``ranges``."""
    found = []
    for bits in {r.bits for r in ranges} if ranges else [FIRST_BITS + STEP]:
        some = groups
        if ranges:  # at most a few thousand ranges: the neighbours of the cuts
            wanted = groups.sparkSession.createDataFrame([(r.slice,) for r in ranges if r.bits == bits], "s long")
            some = groups.join(F.broadcast(wanted), F.shiftright("key", bits) == F.col("s"), "left_semi")
        below = max(0, bits - STEP)
        by = some.groupBy(F.shiftright("key", below).alias("slice")).agg(
            F.sum("size").alias("size"), F.max("size").alias("largest"), (F.min("key") == F.max("key")).alias("atomic")
        )
        found += [Range(r.slice, below, r.size, r.largest, r.atomic) for r in by.collect()]
    return found


class Cuts:
    """Greedy walks over the ranges known so far."""

    def __init__(self, ranges: list[Range], shards: int):
        self.ranges = sorted(ranges, key=lambda r: r.start)
        self.shards = shards
        self.ends = []
        total = 0
        for r in self.ranges:
            total += r.size
            self.ends.append(total)
        self.total = total
        self.least = max([-(-total // shards), *(r.largest for r in self.ranges)], default=0)

    def reach(self, start: int, capacity: int, touched: set[int] | None = None) -> int:
        """The furthest cut at most ``capacity`` beyond ``start``. Inside a divisible range any
        place will do for now; the range is noted in ``touched``."""
        goal = start + capacity
        if goal >= self.total:
            return self.total
        i = bisect_right(self.ends, goal)
        before = self.ends[i - 1] if i else 0
        if self.ranges[i].atomic or goal == before:
            return before
        if touched is not None:
            touched.add(i)
        return goal

    def feasible(self, capacity: int, start: int = 0, shards: int | None = None) -> bool:
        for _ in range(self.shards if shards is None else shards):
            if start >= self.total:
                return True
            start = self.reach(start, capacity)
        return start >= self.total

    def capacity(self) -> int:
        """Binary search for the smallest feasible capacity."""
        low, high = self.least, max(self.total, self.least)
        while low < high:
            mid = (low + high) // 2
            if self.feasible(mid):
                high = mid
            else:
                low = mid + 1
        return low

    def walk(self, capacity: int) -> tuple[list[int], set[int]]:
        """Where the shards end, none above the capacity. A shard takes an equal part of what is
        left, and more only where the rest would not fit otherwise; so one group as large as the
        capacity leaves no shard empty that could be filled."""
        touched: set[int] = set()
        cuts, start = [], 0
        for i in range(self.shards):
            left = self.shards - i
            cut = self.reach(start, min(capacity, -(-(self.total - start) // left)), touched)
            if cut == start or not self.feasible(capacity, cut, left - 1):
                cut = self.reach(start, capacity, touched)
            cuts.append(cut)
            start = cut
        probe = 0
        for _ in range(self.shards):  # the greedy check of the capacity itself
            probe = self.reach(probe, capacity, touched)
        return cuts, touched


def shard_bounds(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the keys at which the next shard begins."""
    ranges = _look(groups)
    while True:
        cuts = Cuts(ranges, shards)
        capacity = cuts.capacity()
        ends, touched = cuts.walk(capacity)
        if not touched:
            break
        near = {j for i in touched for j in range(i - shards, i + shards + 1) if 0 <= j < len(cuts.ranges)}
        split = {r for j in near if not (r := cuts.ranges[j]).atomic}
        ranges = [r for r in ranges if r not in split] + _look(groups, sorted(split, key=lambda r: r.start))
    bounds = []
    for end in ends[:-1]:
        i = bisect_left(cuts.ends, end) + 1 if end else 0
        bounds += [cuts.ranges[i].start] if i < len(cuts.ranges) else []
    return capacity, bounds


def minimax_shards(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, shard, slot. ``slot`` numbers the rows of
    a shard from 0 without gaps."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text).alias("key"),
        (F.octet_length(text).cast("long") + PER_ROW).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
    )
    # sorted by (key, id), also inside a group that many rows share; the row's place is kept
    place = F.monotonically_increasing_id()
    sized = materialized(
        rows.repartitionByRange("key", "id")
        .sortWithinPartitions("key", "id")
        .withColumn("part", F.shiftright(place, 33))
        .withColumn("row", place.bitwiseAND(F.lit((1 << 33) - 1))),
        "sized",
    )
    groups = materialized(sized.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    _, bounds = shard_bounds(groups, shards)
    shard = F.lit(0)
    for bound in bounds:
        shard = shard + (F.col("key") >= F.lit(bound)).cast("int")
    placed = sized.withColumn("shard", shard.cast("int"))
    # rows of a part before each shard: one row per part and shard
    spans = placed.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    spans = spans.join(
        _running(spans, "shard", "part", "n"), ["shard", "part"]
    ).select("shard", "part", (F.col("before") - F.col("first")).alias("shift"))
    return placed.join(spans, ["shard", "part"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("row") + F.col("shift")).alias("slot"),
    )


def _running(df: DataFrame, group: str, order: str, n: str) -> DataFrame:
    """Sum of ``n`` over the earlier rows of a group; ``df`` has one row per part and shard."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.select(group, order, F.coalesce(F.sum(n).over(w), F.lit(0)).alias("before"))
