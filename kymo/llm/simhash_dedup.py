"""Near-duplicate documents by 64-bit SimHash and a self-join of the binary trie of fingerprints.

A fingerprint's bit is set where over half of the document's shingle hashes have it. Equal
fingerprints are one class, so copies are one leaf of the trie. Node pairs are walked together from
the root: a pair of children that differ in a bit has one error more, and a pair beyond ``radius``
errors is dropped with all that lies below. The upper part of the walk is a table of node pairs with
their sizes, opened ``STEP`` bits at a time where a node holds more than its share of leaves; below
that each pair is one group of rows, which a task walks to the leaves. Of the links that a task finds
it returns a spanning forest, so a crowd of near copies costs links in proportion to its size.

Any two leaves within the radius meet in the one pair of nodes above them: nothing is sampled, and no
link between components is lost. Fingerprints are distinct, so at most 43,745 lie within three bits
of one, whatever the number of copies.

Defined cases: NULL, empty and blank texts have fingerprint zero and are linked like others; fewer
than three words are one shingle; repeated rows have equal fingerprints; rows without an id belong to
a component, whose id is the smallest id there is, or NULL if none; very long texts are hashed piece
by piece; extra columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.llm.components import components
from kymo.llm.frames import small
from kymo.session import materialized

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Shingles hashed at once.
CHUNK = 65_536
#: Bits by which an open pair of nodes is taken apart, and the leaves of a node that one task takes:
#: a 32nd of all, within these bounds.
STEP, LEAST, MOST = 3, 1_024, 1 << 18
#: Leaf pairs below which a pair of nodes is compared directly, and node pairs walked at once.
DIRECT, FRONT = 16, 65_536


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a whole text: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + SHINGLE - 1]
        runs = zip(*(part[j:] for j in range(SHINGLE)), strict=False) if len(words) >= SHINGLE else [words]
        codes = np.array([digest(run, SEED) for run in map(b" ".join, runs)], dtype="<u8")
        total += np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1_000):
            some = batch.slice(at, 1_000)
            codes = np.array([fingerprint(t) for t in some.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(codes.view(np.int64))], ["id", "fp"])


class Forest:
    """Components of numbered members, the smallest number as the root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            i, j = self.root[i], self.root[j]
            apart = i != j
            i, j = np.minimum(i[apart], j[apart]), np.maximum(i[apart], j[apart])
            np.minimum.at(self.root, j, i)
            while (up := self.root[self.root] != self.root).any():
                self.root[up] = self.root[self.root[up]]


def walk(a: np.ndarray, b: np.ndarray | None, depth: int, errors: int, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the pairs of ``a`` with ``b`` (``None``: with itself, i < j) that differ in
    at most ``radius`` bits. Both are sorted, distinct, and alike in the first ``depth`` bits but for
    ``errors`` of them. A node is a range of places; its pairs are walked depth-first."""
    same = b is None
    b = a if same else b
    sums: dict[tuple[int, int], np.ndarray] = {}

    def ones(side: int, bit: int) -> np.ndarray:
        if (side, bit) not in sums:
            x = (a, b)[side] >> np.uint64(63 - bit) & np.uint64(1)
            sums[side, bit] = np.concatenate([[0], np.cumsum(x.astype(np.int32))])
        return sums[side, bit]

    whole = tuple(np.array([x]) for x in (0, len(a), 0, len(b), errors))
    todo = [(depth, *whole)]
    while todo:
        depth, a0, a1, b0, b1, e = todo.pop()
        if len(a0) > FRONT:
            half = len(a0) // 2
            todo += [(depth, *(x[:half] for x in (a0, a1, b0, b1, e))), (depth, *(x[half:] for x in (a0, a1, b0, b1, e)))]
            continue
        size = (a1 - a0) * (b1 - b0)
        few = size <= DIRECT
        if few.any():
            n, width = size[few], (b1 - b0)[few]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat(width, n)
            i, j = np.repeat(a0[few], n) + place // width, np.repeat(b0[few], n) + place % width
            near = np.bitwise_count(a[i] ^ b[j]) <= radius
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
        a0, a1, b0, b1, e = (x[~few] for x in (a0, a1, b0, b1, e))
        if not len(a0):
            continue
        # the places from am (bm) on have the next bit set
        ca, cb = ones(0, depth), ones(0 if same else 1, depth)
        am, bm = a1 - (ca[a1] - ca[a0]), b1 - (cb[b1] - cb[b0])
        twin = (a0 == b0) & (a1 == b1) if same else np.zeros(len(a0), bool)
        children = [(a0, am, b0, bm, e), (am, a1, bm, b1, e), (a0, am, bm, b1, e + 1)]
        children.append(tuple(x[~twin] for x in (am, a1, b0, bm, e + 1)))
        pairs = [np.concatenate(x) for x in zip(*children, strict=True)]
        live = (pairs[0] < pairs[1]) & (pairs[2] < pairs[3]) & (pairs[4] <= radius)
        if live.any():
            todo.append((depth + 1, *(x[live] for x in pairs)))


def _walked(radius: int):
    """Rows sorted by (depth, p, q) -> links (u, v) of a spanning forest of each pair of nodes."""

    def group(depth: int, p: int, q: int, side: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        fp = fp.view(np.uint64)
        a, b = np.sort(fp[side == 0]), np.sort(fp[side == 1])
        forest = Forest(len(a) + len(b))
        if p == q:
            found = walk(a, None, depth, 0, radius)
        else:
            found = walk(a, b, depth, (p ^ q).bit_count(), radius)
        for i, j in found:
            forest.join(i, j if p == q else j + len(a))
        below = np.flatnonzero(forest.root != np.arange(len(forest.root)))
        if not len(below):
            return None
        every = np.concatenate([a, b]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(every[below]), pa.array(every[forest.root[below]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def ended():
            if now is not None:
                side, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
                if (out := group(*now, side, fp)) is not None:
                    yield out

        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("depth", "p", "q")]
            side, fp = batch.column("side").to_numpy(), batch.column("fp").to_numpy()
            turn = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            edges = [0, *(np.flatnonzero(turn) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                key = tuple(int(k[lo]) for k in keys)
                if key != now:
                    yield from ended()
                    now, parts = key, []
                parts.append((side[lo:hi], fp[lo:hi]))
        yield from ended()

    return run


def _prefix(depth: int):
    return F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")


def _node_pairs(leaves: DataFrame, radius: int, share: int) -> list[tuple[int, DataFrame]]:
    """The pairs of nodes (p, q) at which tasks start, by depth. Pairs are opened while a node of
    theirs holds more than ``share`` leaves; tables hold nodes and their sizes, never leaves."""
    ready, depth = [], 0
    pairs = leaves.agg(F.count("*").alias("n")).select(*(F.lit(0).cast("long").alias(c) for c in "pq"), F.col("n").alias("n_p"), F.col("n").alias("n_q"))
    while True:
        pairs = materialized(pairs, "node-pairs")
        wide = F.greatest("n_p", "n_q") > share
        ready.append((depth, pairs.where(~wide).select("p", "q")))
        if depth >= 63 or not pairs.where(wide).limit(1).count():
            return ready
        below = min(64, depth + STEP)
        kids = leaves.groupBy(_prefix(depth).alias("up"), _prefix(below).alias("kid")).count()
        kids = small(materialized(kids, "nodes"))
        left, right = (kids.select(F.col("up").alias(c), F.col("kid").alias(f"{c}_"), F.col("count").alias(f"m_{c}")) for c in "pq")
        pairs = (
            pairs.where(wide).join(left, "p").join(right, "q")
            .where(F.bit_count(F.col("p_").bitwiseXOR(F.col("q_"))) <= radius)
            .where("p < q OR p_ <= q_")
            .select(F.col("p_").alias("p"), F.col("q_").alias("q"), F.col("m_p").alias("n_p"), F.col("m_q").alias("n_q"))
        )
        depth = below


def trie_links(leaves: DataFrame, radius: int = RADIUS, share: int | None = None) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``leaves`` (fp) that differ in at most ``radius``
    bits: a forest for each pair of nodes, together connecting all that are linked."""
    if share is None:
        share = min(MOST, max(LEAST, leaves.count() // 32))
    rows = None
    for depth, pairs in _node_pairs(leaves, radius, share):
        sides = pairs.select("p", "q", F.lit(0).alias("side"), F.col("p").alias("node"))
        sides = sides.unionByName(pairs.where("p <> q").select("p", "q", F.lit(1).alias("side"), F.col("q").alias("node")))
        met = leaves.withColumn("node", _prefix(depth)).join(small(sides), "node")
        met = met.select(F.lit(depth).alias("depth"), "p", "q", "side", "fp")
        rows = met if rows is None else rows.unionByName(met)
    dealt = rows.repartition("depth", "p", "q").sortWithinPartitions("depth", "p", "q")
    return dealt.mapInArrow(_walked(radius), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: id, fp (signed), component_id, kept."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    signed = materialized(rows.mapInArrow(_fingerprints, f"id {kind}, fp long"), "fingerprints")
    classes = materialized(signed.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    links = materialized(trie_links(classes.select("fp"), radius), "links")
    parts = components(links).withColumnRenamed("node", "fp")
    state = classes.join(parts, "fp", "left").where("copies > 1 OR component IS NOT NULL")
    state = state.withColumn("component", F.coalesce("component", "fp"))
    least = state.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = materialized(state.join(least, "component").select("fp", "component_id", F.lit(True).alias("grouped")), "named")
    component = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("id"))
    return signed.join(small(named), "fp", "left").select(
        F.col("id").alias(id_col), "fp", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )
