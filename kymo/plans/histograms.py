"""Second-order boosted trees: histograms of quantile bins, many boosters a level at a time.

Rows are cut to bin codes once and stored. A pass over them brings every booster one level further,
whatever its round, settings or fold: each task sums the residuals by (booster, node, feature, bin),
the sums meet in a shuffle by (booster, node), and one row with the best split of each node comes
back; sums of few boosters (at most ``DRIVER_SUMS`` bytes over all tasks) meet in the driver instead. Squared error has a second derivative of one, so a node's weight is its row count, and its value
is ``rate * residuals / (count + l2)``.

Predictions are carried along: after ``RESTAGE`` trees the rows are written again with the boosters'
predictions so far, so a pass evaluates a bounded number of trees, and a lost executor repeats one
pass. The driver holds trees, one row a node and those sums, never rows of data.

Tables of at most ``PART_ROWS`` rows fit one task, whose sums need no shuffle: there a pass brings each
booster ``ROUNDS`` trees further instead of one level, and the boosters are dealt over tasks that each
read all rows, with the predictions of their own boosters. Larger tables go a level a pass, in blocks, and
no task holds more than a block. Trees are the same either way.
"""

from __future__ import annotations

import itertools
import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.session import materialized

BINS = 32
#: Trees that a pass evaluates at most, and rows of a table that one task holds: about 50 bytes each (50 MB,
#: two or three times that while they are read) and 4 bytes a booster of the task.
RESTAGE, PART_ROWS = 16, 1_000_000
#: Rows of a stored partition, which holds the predictions of all boosters, and of a block of it.
STORED_ROWS, BLOCK_ROWS = 200_000, 100_000
#: Rounds of a pass over a table that fits one task.
ROUNDS = 10
#: Rows times boosters that are worth a task, and bytes of sums that a pass adds up in the driver.
TASK_ROWS, DRIVER_SUMS = 50_000, 4_000_000
#: Rows for each cell of a table that counts several columns at once.
JOINED = 16
NO_SPLIT = 255
TRAIN, EVALUATE, TEST = 1, 2, 3


@dataclass
class Tree:
    """A complete binary tree of ``depth`` levels in heap order: rows with a code above ``cut`` go
    right. A node without a split sends all rows left. ``cover`` counts training rows of each node."""

    depth: int
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        inner = 2**depth - 1
        return Tree(depth, np.zeros(inner, np.int16), np.full(inner, NO_SPLIT, np.uint8), np.zeros(2**depth), np.zeros(2 * inner + 1))

    def nodes(self, codes: np.ndarray, level: int) -> np.ndarray:
        """Place, within its level, of each row's node. Every split of these few levels is asked of
        every row, column by column, and its sides are chosen by bit masks, in less than a tenth of
        the time of each row's own way down."""

        def below(at: int, level: int) -> np.ndarray | None:
            """Place of each row in the last of ``level`` levels under node ``at``; None: all in the first."""
            if not level:
                return None
            left, right = below(2 * at + 1, level - 1), below(2 * at + 2, level - 1)
            if self.cut[at] == NO_SPLIT:  # no code is above it
                return left
            goes = -(codes[:, self.feature[at]] > self.cut[at]).view(np.uint8)  # all bits of a row that goes right
            half = np.uint8(1 << (level - 1))
            right = half if right is None else right + half
            return goes & right if left is None else left ^ ((left ^ right) & goes)

        if level > 8:  # more nodes than a byte can tell apart, and too many splits to ask of all rows
            at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
            for _ in range(level):
                at = 2 * at + 1 + (codes[rows, self.feature[at]] > self.cut[at])
            return at - (2**level - 1)
        place = below(0, level)
        return np.zeros(len(codes), np.uint8) if place is None else place

    def predict(self, codes: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(codes, self.depth)]


@dataclass
class Booster:
    """One model in the making: its settings, the fold it learns, and where it stands."""

    number: int
    settings: dict
    fold: int = 0
    trees: list[Tree] = field(default_factory=list)
    base: float = 0.0
    growing: Tree | None = None
    level: int = 0
    columns: np.ndarray | None = None
    staged: int = 0
    #: By number of trees: root mean square error on the evaluation rows, mean absolute error on
    #: these and on the test rows.
    rmse: list[float] = field(default_factory=list)
    mae: list[float] = field(default_factory=list)
    test_mae: list[float] = field(default_factory=list)
    done: bool = False

    @property
    def best(self) -> int:
        """Number of trees of least error; all where there was nothing to evaluate."""
        known = [e if e == e else np.inf for e in self.rmse[1:]]
        if not known or not np.isfinite(min(known)):
            return len(self.trees)
        return 1 + int(np.argmin(known))

    def start_round(self, width: int) -> None:
        share = self.settings["columns"]
        rng = np.random.default_rng([self.settings["seed"], self.fold, len(self.trees)])
        self.columns = np.sort(rng.choice(width, max(1, round(share * width)), replace=False))
        self.growing, self.level = Tree.empty(self.settings["max_depth"]), 0

    def job(self) -> dict:
        """What tasks need to know of this booster in the next pass."""
        return {
            "number": self.number, "fold": self.fold, "base": self.base, "new": self.trees[self.staged :], "tree": self.growing,
            "level": self.level, "columns": self.columns, "round": len(self.trees), "settings": self.settings,
        }


def quantile_edges(df: DataFrame, cols: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """At most ``bins - 1`` rising edges of each column, from one bounded sketch a column."""
    at = [k / bins for k in range(1, bins)]
    found = df.agg(*(F.percentile_approx(c, at, 100 * bins).alias(f"e{i}") for i, c in enumerate(cols))).first()
    return [np.unique(np.array(e, float)) if e else np.zeros(0) for e in found]


def binned(df: DataFrame, cols: Sequence[str], edges: list[np.ndarray]) -> DataFrame:
    """(rid, y, roles, codes) of rows (rid, y, roles, *cols): one byte a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.zeros((batch.num_rows, len(cols)), np.uint8)
            for i, c in enumerate(cols):
                codes[:, i] = np.searchsorted(edges[i], batch.column(c).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("y"), batch.column("roles"), _bytes(codes), _bytes(np.zeros((batch.num_rows, 0), np.float32))],
                ["rid", "y", "roles", "codes", "so_far"],
            )

    return df.mapInArrow(run, "rid long, y double, roles binary, codes binary, so_far binary")


def _bytes(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int64) * (rows.shape[1] * rows.itemsize)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _matrix(column: pa.Array | pa.ChunkedArray, kind) -> np.ndarray:
    """Rows of equal length as one matrix, a view of the Arrow buffer."""
    if isinstance(column, pa.ChunkedArray):
        return np.concatenate([_matrix(c, kind) for c in column.chunks if len(c)])
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, wide)[column.offset : column.offset + len(column) + 1]
    found = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return found.view(kind).reshape(len(column), -1)


BLOCK_COLUMNS = ["rid", "y", "roles", "codes", "so_far"]
BLOCK_SCHEMA = ", ".join(f"{c} binary" for c in BLOCK_COLUMNS)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``BLOCK_ROWS`` rows or more -> one row that holds their columns as bytes, so that a pass reads few rows."""

    def block(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(some)
        plain = [rows.column("rid").to_numpy(), rows.column("y").to_numpy(), *(_matrix(rows.column(c), np.uint8) for c in BLOCK_COLUMNS[2:])]
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in plain], BLOCK_COLUMNS)

    some, n = [], 0
    for batch in batches:
        if batch.num_rows:
            some.append(batch)
            n += batch.num_rows
        if n >= BLOCK_ROWS:
            yield block(some)
            some, n = [], 0
    if some:
        yield block(some)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(rid, y, roles, codes, so_far) of each packed row; codes and ``so_far`` lie together by column."""
    for batch in batches:
        for at in range(batch.num_rows):
            rid, y, roles, codes, so_far = (memoryview(batch.column(c)[at].as_buffer()) for c in BLOCK_COLUMNS)
            n = len(rid) // 8
            roles, codes = (np.frombuffer(x, np.uint8).reshape(n, -1) for x in (roles, codes))
            yield np.frombuffer(rid, np.int64), np.frombuffer(y), roles, np.asfortranarray(codes), np.frombuffer(so_far, np.float32).reshape(-1, n).T


def _predictions(job: dict, codes: np.ndarray, so_far: np.ndarray, order: dict[int, int]) -> np.ndarray:
    out = so_far[:, order[job["number"]]].astype(float) if job["number"] in order else np.full(len(codes), job["base"])
    for tree in job["new"]:
        out += tree.predict(codes)
    return out


def _drawn(rid: np.ndarray, job: dict) -> np.ndarray:
    """The rows that this round learns from, decided by row id and round."""
    share = job["settings"]["subsample"]
    if share >= 1:
        return np.ones(len(rid), bool)
    key = (job["settings"]["seed"] * 0x9E3779B97F4A7C15 + job["round"] * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
    x = rid.view(np.uint64) ^ np.uint64(key)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x ^= x >> np.uint64(33)
        x *= np.uint64(factor)
    x >>= np.uint64(11)
    return x.astype(float) < share * 2.0**53


@dataclass
class _Fold:
    """The places of a fold's rows by role, the ids of those it learns from, and room for their codes."""

    places: dict[int, np.ndarray]
    rid: np.ndarray
    room: np.ndarray

    @staticmethod
    def of(role: np.ndarray, rid: np.ndarray, width: int) -> _Fold:
        places = {kind: np.flatnonzero(role == kind) for kind in (TRAIN, EVALUATE, TEST)}
        return _Fold(places, rid.take(places[TRAIN]), np.empty((width, len(places[TRAIN])), np.uint8))

    def learned(self, job: dict, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows that a round learns from, and their codes of its columns, until the next
        call; all levels use them."""
        rows = self.places[TRAIN][_drawn(self.rid, job)]
        for c in job["columns"]:
            np.take(codes[:, c], rows, out=self.room[c, : len(rows)], mode="clip")  # no copy between
        return rows, self.room[:, : len(rows)].T


def _joined(sizes: list[int], nodes: int, most: int) -> list[list[int]]:
    """Neighbouring columns that are counted in one table of at most ``most`` cells (and 32,768, which
    stay in a core's cache), or alone."""
    out, cells = [], 0
    for j, size in enumerate(sizes):
        if out and cells * size <= min(most, 1 << 15):
            out[-1].append(j)
            cells *= size
        else:
            out.append([j])
            cells = nodes * size
    return out


def _job_sums(job: dict, fold: _Fold, learned: tuple[np.ndarray, np.ndarray], error: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(node, sums) of some rows for a booster's next level."""
    if job["level"] == 0:
        for node, kind in ((-1, EVALUATE), (-2, TEST)):
            e = error.take(fold.places[kind])
            yield node, np.array([len(e), (e * e).sum(), np.abs(e).sum()])
    rows, picked = learned
    if job["tree"] is None or not len(rows):
        return
    columns, n = job["columns"], 2 ** job["level"]
    node, e = job["tree"].nodes(picked, job["level"]), error.take(rows)
    g, h = np.zeros((n, len(columns), BINS)), np.zeros((n, len(columns), BINS))
    sizes = [int(picked[:, c].max()) + 1 for c in columns]
    for some in _joined(sizes, n, len(rows) // JOINED):
        shape = (n, *(sizes[j] for j in some))
        total = math.prod(shape)
        at = node.astype(np.uint16 if total <= 1 << 16 else np.int64)  # narrow numbers add up many at once
        for j in some:
            at *= at.dtype.type(sizes[j])
            at += picked[:, columns[j]]
        at = at.astype(np.int64)
        for out, counted in ((g, np.bincount(at, e, total)), (h, np.bincount(at, minlength=total))):
            counted = counted.reshape(shape)
            for axis, j in enumerate(some, 1):
                out[:, j, : sizes[j]] = counted.sum(axis=tuple(k for k in range(1, len(shape)) if k != axis))
    for i in np.flatnonzero(h[:, 0].sum(axis=1)):
        yield int(i), np.concatenate([g[i].ravel(), h[i].ravel()])


def _decided(job: dict, node: int, x: np.ndarray) -> list[float]:
    """What the whole sums of a node say: its errors, or its totals and best split."""
    if node < 0:
        return x.tolist()
    g, h = x.reshape(2, len(job["columns"]), BINS)
    found = best_split(g, h, job["settings"]["min_child"], job["settings"]["l2"])
    return [float(g[0].sum()), float(h[0].sum()), *(found or [])]


def _summed(jobs, order: dict[int, int], width: int):
    """Sums of one task: (booster, node, sums): node -1 and -2 are the errors on evaluation and test
    rows, others the residuals and counts by (feature, bin)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}

        def add(key, x):
            total[key] = total[key] + x if key in total else x

        for rid, y, roles, codes, so_far in _blocks(batches):
            folds = [_Fold.of(roles[:, f], rid, width) for f in range(roles.shape[1])]
            for job in jobs.value:
                fold = folds[job["fold"]]
                error = y - _predictions(job, codes, so_far, order)
                for node, x in _job_sums(job, fold, fold.learned(job, codes), error):
                    add((job["number"], node), x)
        keys = list(total)
        for at in range(0, len(keys), 256):
            some = keys[at : at + 256]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in some], pa.int32()), pa.array([k[1] for k in some], pa.int32()), pa.array([total[k].tobytes() for k in some], pa.binary())],
                ["booster", "node", "sums"],
            )

    return run


def best_split(g: np.ndarray, h: np.ndarray, least: float, l2: float) -> tuple | None:
    """(gain, feature, bin, residuals and rows to the left, of all) of the best split of a node from
    (feature, bin) sums; the first of equals; ``None`` if none gains."""
    left_g, left_h = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
    all_g, all_h = g[0].sum(), h[0].sum()
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - all_g**2 / (all_h + l2)
    gain = np.where((left_h >= max(least, 1)) & (right_h >= max(least, 1)), gain, -np.inf)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    if not gain[f, b] > 1e-9:
        return None
    return float(gain[f, b]), int(f), int(b), float(left_g[f, b]), float(left_h[f, b])


def _merged(jobs: list[dict], batches: Iterator[pa.RecordBatch]) -> list[tuple[int, int, list[float]]]:
    """(booster, node, decision) from the sums of all tasks."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for b, n, s in zip(*(batch.column(c).to_pylist() for c in ("booster", "node", "sums")), strict=True):
            x = np.frombuffer(s)
            total[b, n] = total[b, n] + x if (b, n) in total else x
    by_number = {job["number"]: job for job in jobs}
    return [(number, node, _decided(by_number[number], node, x)) for (number, node), x in total.items()]


def _split(jobs):
    """Sums of one (booster, node) from all tasks -> its best split, or its errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _merged(jobs.value, batches)
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["booster", "node", "found"])

    return run


def _advance(booster: Booster, found: dict[int, list[float]], width: int, rounds: int, patience: int) -> None:
    """Use a pass's results: errors at the start of a round, then one more level of the tree."""
    if booster.level == 0:
        for node, lists in ((-1, (booster.rmse, booster.mae)), (-2, (None, booster.test_mae))):
            n, square, absolute = found.get(node, (0, 0, 0))
            for out, x in zip(lists, ((square / n) ** 0.5, absolute / n) if n else (np.nan, np.nan), strict=True):
                if out is not None:
                    out.append(x)
        waited = len(booster.trees) - booster.best if len(booster.rmse) > 1 and booster.rmse[-1] == booster.rmse[-1] else 0
        if len(booster.trees) >= rounds or waited >= patience or 0 not in found:
            booster.done, booster.growing = True, None
            return
    tree, settings = booster.growing, booster.settings
    value = lambda g, h: settings["rate"] * g / (h + settings["l2"])
    first, below = 2**booster.level - 1, tree.depth - booster.level
    split = False
    for node, x in found.items():
        if node < 0:
            continue
        at = first + node
        tree.cover[at] = x[1]
        leaves = slice(node << below, (node + 1) << below)
        if len(x) == 2:
            tree.value[leaves] = value(*x)
            continue
        split = True
        _, f, b, left_g, left_h = x[2:]
        tree.feature[at], tree.cut[at] = booster.columns[int(f)], int(b)
        half = 1 << (below - 1)
        tree.value[leaves.start : leaves.start + half] = value(left_g, left_h)
        tree.value[leaves.start + half : leaves.stop] = value(x[0] - left_g, x[1] - left_h)
        tree.cover[2 * at + 1], tree.cover[2 * at + 2] = left_h, x[1] - left_h
    booster.level += 1
    if booster.level == tree.depth or not split:
        booster.trees.append(tree)
        booster.start_round(width)


def _whole(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    """(rid, y, roles, codes, so_far) of all packed rows, in an order that does not depend on their arrival."""
    blocks = sorted(_blocks(batches), key=lambda block: block[0][0])
    rid, y, roles, codes, so_far = map(np.concatenate, zip(*blocks, strict=True))
    return rid, y, roles, np.asfortranarray(codes), so_far


def _dealt(columns: list[list[int]]):
    """Packed rows once a lane, each with the predictions (columns of ``so_far``) of its own boosters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                rid, *same, so_far = (batch.column(c).slice(at, 1) for c in BLOCK_COLUMNS)
                now = np.frombuffer(so_far[0].as_buffer(), np.float32).reshape(-1, len(rid[0].as_buffer()) // 8)
                for lane, mine in enumerate(columns):
                    yield pa.RecordBatch.from_arrays([pa.array([lane], pa.int32()), rid, *same, pa.array([now[mine].tobytes()], pa.binary())], ["lane", *BLOCK_COLUMNS])

    return run


def _grown_alone(lanes, order: dict[int, int], width: int, rounds: int, patience: int):
    """The boosters of this task's lane, ``ROUNDS`` trees further; the task holds all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (head := next(batches, None)) is None:
            return
        boosters = lanes.value[head.column("lane")[0].as_py()]
        held = {b.number: i for i, b in enumerate(b for b in boosters if b.number in order)}
        rid, y, roles, codes, so_far = _whole(itertools.chain([head], batches))
        del head  # its bytes are in arrays now
        folds: dict[int, _Fold] = {}
        for booster in boosters:
            job, learned = booster.job(), None
            fold = folds[job["fold"]] = folds.get(job["fold"]) or _Fold.of(roles[:, job["fold"]], rid, width)
            now = _predictions(job, codes, so_far, held)
            stop = (len(booster.trees) // ROUNDS + 1) * ROUNDS
            # ends where the errors after ``stop`` trees are known
            while not booster.done and (len(booster.trees), booster.level) < (stop, 1):
                job, known = booster.job(), len(booster.trees)
                if learned is None or job["level"] == 0:
                    learned, error = fold.learned(job, codes), y - now
                found = {node: _decided(job, node, x) for node, x in _job_sums(job, fold, learned, error)}
                _advance(booster, found, width, booster.settings.get("rounds", rounds), patience)
                for tree in booster.trees[known:]:
                    now += tree.predict(codes)
            yield pa.RecordBatch.from_arrays([pa.array([booster.number]), pa.array([pickle.dumps(booster)])], ["booster", "state"])

    return run


def _lanes(active: list[Booster], lanes: int, learning: Sequence[int]) -> list[list[Booster]]:
    """The boosters dealt to tasks, the longest first, each to the task with the least to do;
    ``learning`` counts the training rows of each fold."""
    dealt, load = [[] for _ in range(lanes)], [0.0] * lanes
    work = lambda b: learning[b.fold] * b.settings["subsample"] * b.settings["columns"] * b.settings["max_depth"]
    for b in sorted(active, key=work, reverse=True):
        at = load.index(min(load))
        dealt[at].append(b)
        load[at] += max(work(b), 1)
    return dealt


def _pass_alone(rows: DataFrame, active: list[Booster], order: dict[int, int], width: int, rounds: int, patience: int, learning: Sequence[int]) -> None:
    """One pass over packed rows, at most ``PART_ROWS``, which each lane reads whole."""
    context = rows.sparkSession.sparkContext
    lanes = _lanes(active, max(1, min(context.defaultParallelism, len(active))), learning)
    columns = [[order[b.number] for b in lane if b.number in order] for lane in lanes]
    dealt = rows.mapInArrow(_dealt(columns), f"lane int, {BLOCK_SCHEMA}").repartitionById(len(lanes), "lane")
    sent = context.broadcast(lanes)
    grown = dealt.mapInArrow(_grown_alone(sent, order, width, rounds, patience), "booster long, state binary")
    states = {r["booster"]: r["state"] for r in grown.toArrow().to_pylist()}  # one row a booster
    sent.destroy()
    for b in active:
        vars(b).update(vars(pickle.loads(states[b.number])))


def grow(rows: DataFrame, boosters: Iterator[Booster], slots: int, width: int, rounds: int, patience: int, report=None) -> list[Booster]:
    """Train the boosters that ``boosters`` yields, ``slots`` at a time, on binned ``rows``; as one
    ends, the next takes its place. ``report(active)`` sees each pass and may mark some as done."""
    spark = rows.sparkSession
    rows = materialized(rows, "boost-binned")
    folds = range(len(rows.select("roles").first()[0])) if rows.limit(1).count() else []
    learns = [F.substring("roles", f + 1, 1) == bytes([TRAIN]) for f in folds]
    means = rows.agg(F.count("*"), *(F.avg(F.when(x, F.col("y"))) for x in learns), *(F.count_if(x) for x in learns)).first()
    learning = means[1 + len(folds) :]
    alone = 0 < means[0] <= PART_ROWS
    # a task for each STORED_ROWS rows of data, or TASK_ROWS rows (times boosters, if they share a pass) as far as there are cores
    parts = max(1, min(spark.sparkContext.defaultParallelism, means[0] * (1 if alone else slots) // TASK_ROWS), -(-means[0] // min(PART_ROWS, STORED_ROWS)))
    dealt = rows.repartition(parts, "rid")
    dealt = dealt.sortWithinPartitions("rid", "y") if parts > 1 else dealt  # sums add up in the same order each time
    rows = materialized(dealt.mapInArrow(_packed, BLOCK_SCHEMA), "boost-rows")
    active: list[Booster] = []
    order: dict[int, int] = {}
    done: list[Booster] = []
    while True:
        while len(active) < slots and (fresh := next(boosters, None)) is not None:
            if means[0] and means[1 + fresh.fold] is not None:
                fresh.base = means[1 + fresh.fold]
                fresh.start_round(width)
                active.append(fresh)
            else:
                fresh.done = True
                done.append(fresh)
        if not active:
            return done
        if max(len(b.trees) - b.staged for b in active) >= RESTAGE:
            rows, order = materialized(_restaged(rows, active, order), "boost-rows"), {b.number: i for i, b in enumerate(active)}
            for b in active:
                b.staged = len(b.trees)
        if alone:
            _pass_alone(rows, active, order, width, rounds, patience, learning)
        else:
            _pass_by_level(rows, active, order, width, rounds, patience, parts)
        if report:
            report(active)
        done += [b for b in active if b.done]
        active = [b for b in active if not b.done]


def _pass_by_level(rows: DataFrame, active: list[Booster], order: dict[int, int], width: int, rounds: int, patience: int, parts: int) -> None:
    """One pass over the packed rows of any table: every booster a level further."""
    todo = [b.job() for b in active]
    jobs = rows.sparkSession.sparkContext.broadcast(todo)
    sums = rows.mapInArrow(_summed(jobs, order, width), "booster int, node int, sums binary")
    found: dict[int, dict[int, list[float]]] = {b.number: {} for b in active}
    if parts * sum(2 ** job["level"] * len(job["columns"]) * BINS * 16 for job in todo) <= DRIVER_SUMS:
        decided = _merged(todo, sums.toArrow().to_batches())
    else:
        sums = sums.repartition("booster", "node") if parts > 1 else sums  # one task has all sums of its rows
        best = sums.mapInArrow(_split(jobs), "booster int, node int, found array<double>")
        decided = [(r["booster"], r["node"], r["found"]) for r in best.toArrow().to_pylist()]  # one row a node that is being split
    for number, node, x in decided:
        found[number][node] = x
    jobs.destroy()
    for b in active:
        _advance(b, found[b.number], width, b.settings.get("rounds", rounds), patience)


def _restaged(rows: DataFrame, active: list[Booster], order: dict[int, int]) -> DataFrame:
    """``rows`` with the predictions of the active boosters, in their order, one booster after the other."""
    jobs = rows.sparkSession.sparkContext.broadcast([b.job() for b in active])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rid, y, roles, codes, so_far in _blocks(batches):
            now = np.stack([_predictions(job, codes, so_far, order).astype(np.float32) for job in jobs.value])
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (rid, y, roles, codes, now)], BLOCK_COLUMNS)

    return rows.mapInArrow(run, rows.schema)
