"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations give every signature coordinate: the first scatters the shingles, the second,
shifted circularly by k, orders them for coordinate k. Both are bijections of 32-bit numbers.
Documents with equal shingle sets are one class from the start, so large groups of copies are one
row. Classes that agree on a band meet in a bucket, and buckets are dealt out in blocks:

1. each block proposes a spanning forest of its most similar members; the pairs are verified on the
   full shingle sets, and verified links are joined into components;
2. every pair of different components that shares a bucket and is still open is compared by its
   signatures, one pair of blocks a group, and verified likewise; blocks whose set sizes are too far
   apart do not meet.

Members of the same component need no further link, so a group of many copies costs links in
proportion to its size, and no link between components is left out. The bands find a pair at a
similarity of 0.75 with a probability above 0.99999; a signature of 512 coordinates drops a pair
below ``CUT``, five standard deviations under 0.75.

Defined cases: NULL, empty and blank texts have an empty set and are linked with nothing; fewer
than five words are one shingle; repeated rows are equal sets and thus linked; the component of a
group without any id is NULL; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kymo.llm.components import components
from kymo.llm.frames import bounded, free, released, small
from kymo.llm.words import WordHashes, mixed, shingle_set
from kymo.session import materialized

COORDINATES, BANDS, ROWS = 512, 32, 4
#: Similarity in hundredths, and the estimate below which a pair cannot reach it.
PERCENT, CUT = 75, 0.654
#: Members of a bucket that one block holds, and at most where thousands stay open; shingles hashed
#: at once.
BLOCK, WIDE, CHUNK = 256, 2_048, 32_768
#: Members whose logarithms to this base differ by two or more have sizes too far apart to link.
RANGE = 1.34


def circulant_signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures of non-empty sets, one row each: for coordinate k the smallest second permutation
    of (first permutation - k)."""
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    x = mixed(np.concatenate(sets)).astype(np.uint32)  # the first permutation
    y, z = np.empty_like(x), np.empty_like(x)
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        np.subtract(x, np.uint32(k), out=y)
        np.multiply(y, np.uint32(0x85EBCA6B), out=y)
        np.right_shift(y, np.uint32(15), out=z)
        np.bitwise_xor(y, z, out=y)
        np.multiply(y, np.uint32(0xC2B2AE35), out=y)
        out[:, k] = np.minimum.reduceat(y, starts)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    part = signatures[:, : BANDS * ROWS].reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        key = mixed(key + part[:, :, j] * np.uint64(0xC2B2AE3D27D4EB4F))
    return key.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a text column and others -> the others with the set's size, two digests of the
    set, its band keys and the low bytes of its signature."""
    words = WordHashes()
    for batch in batches:
        others = [n for n in batch.schema.names if n != "text"]
        for at in range(0, batch.num_rows, 512):
            some = batch.slice(at, 512)
            sets = [shingle_set(words.of(t)) for t in some.column("text").to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            low = np.array([int(s.sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64)
            high = np.array([int(mixed(s).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64)
            keys, low_bytes = [None] * len(sets), [None] * len(sets)
            full = np.flatnonzero(sizes)
            i = 0
            while i < len(full):
                j = max(i + 1, int(np.searchsorted(np.cumsum(sizes[full[i:]]), CHUNK)) + i)
                signatures = circulant_signatures([sets[d] for d in full[i:j]])
                for d, key, sign in zip(full[i:j], band_keys(signatures), signatures.astype(np.uint8), strict=True):
                    keys[d], low_bytes[d] = key, sign.tobytes()
                i = j
            columns = [some.column(n) for n in others]
            columns += [
                pa.array(sizes), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)),
                pa.array(keys, pa.list_(pa.int64())), pa.array(low_bytes, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*others, "n", "low", "high", "keys", "sign"])


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of each row of ``a`` with each of ``b``; low bytes agree by chance once in 256."""
    agree = np.array([(b == row).sum(axis=1) for row in a], dtype=np.float64).reshape(len(a), len(b)) / COORDINATES
    return (agree - 1 / 256) / (1 - 1 / 256)


def _may_link(sign: np.ndarray, n: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of rows against columns, and which of them can reach the threshold: sizes too far
    apart cannot."""
    close = _estimates(sign[rows], sign[columns])
    small = np.minimum(n[rows][:, None], n[columns][None, :])
    large = np.maximum(n[rows][:, None], n[columns][None, :])
    return close, (close >= CUT) & (100 * small >= PERCENT * large)


def spanning_pairs(cid: np.ndarray, n: np.ndarray, sign: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the members that may be linked, most similar first."""
    m = len(cid)
    close, may = _may_link(sign, n, np.arange(m), np.arange(m))
    close = np.where(may, close, -1.0)
    best, parent, done = np.full(m, -1.0), np.full(m, -1), np.zeros(m, bool)
    pairs = []
    for _ in range(m):
        at = int(np.where(done, -2.0, best).argmax())
        done[at] = True
        if parent[at] >= 0:
            pairs.append((cid[at], cid[parent[at]]))
        better = ~done & (close[at] > best)
        best[better], parent[better] = close[at][better], at
    return pairs


def open_pairs(cid, n, sign, component, stray, own, block, earlier) -> list[tuple[int, int]]:
    """All pairs of different components that may be linked, between the two blocks of ``block`` or
    within its one. A pair that shares several buckets counts in the first of these: ``earlier`` are
    the members' keys of the bands before this one."""
    pairs, low, high = [], block >> 32, block & 0xFFFFFFFF
    left, right = (np.flatnonzero(stray), np.arange(len(cid))) if low == high else (np.flatnonzero(own == low), np.flatnonzero(own == high))
    for at in range(0, len(left), BLOCK):
        rows = left[at : at + BLOCK]
        _, may = _may_link(sign, n, rows, right)
        may &= component[rows][:, None] != component[right][None, :]
        if low == high:
            may &= ~stray[None, :] | (rows[:, None] < right[None, :])
        i, j = np.nonzero(may)
        i, j = rows[i], right[j]
        here = np.ones(len(i), bool)
        for key in earlier.T:
            here &= key[i] != key[j]
        pairs += list(zip(cid[i[here]], cid[j[here]], strict=True))
    return pairs


def _by_bucket(propose):
    """Stream over rows sorted by (key, block): ``propose`` gives the pairs of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _ended(batches):
            table = rest if batch is None else pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            if table is None or not table.num_rows:
                continue
            key, block = table.column("key").to_numpy(), table.column("block").to_numpy()
            edges = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
            bounds = [0, *edges.tolist(), *([len(key)] if batch is None else [])]
            rest = table.slice(bounds[-1]) if batch is not None else None
            if len(bounds) < 2:
                continue
            part = table.slice(0, bounds[-1])
            columns = {c: part.column(c).to_numpy() for c in part.column_names if c != "sign"}
            sign = np.frombuffer(b"".join(part.column("sign").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            pairs = []
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if hi - lo > 1:
                    pairs += propose(sign[lo:hi], {c: v[lo:hi] for c, v in columns.items()})
            for at in range(0, len(pairs), 50_000):
                ab = np.sort(np.array(pairs[at : at + 50_000], np.int64).reshape(-1, 2), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

    return run


def _ended(batches):
    yield from batches
    yield None


def _forest(sign, rows):
    return spanning_pairs(rows["cid"], rows["n"], sign)


def _between(sign, rows):
    earlier = np.stack(rows["earlier"])
    return open_pairs(rows["cid"], rows["n"], sign, rows["component"], rows["stray"], rows["own"], rows["block"][0], earlier)


def _proposed(rows: DataFrame, propose) -> DataFrame:
    """Distinct pairs proposed within each (key, block)."""
    dealt = rows.repartition("key", "block").sortWithinPartitions("key", "block")
    return dealt.mapInArrow(released(_by_bucket(propose)), "a long, b long").distinct()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both texts -> whether 100 * intersection >= 75 * union of their shingle sets."""
    words = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            sets: dict[str, np.ndarray] = {}
            yes = []
            for s, t in zip(some.column("text_a").to_pylist(), some.column("text_b").to_pylist(), strict=True):
                a, b = (sets[x] if x in sets else sets.setdefault(x, shingle_set(words.of(x))) for x in (s, t))
                shared = len(np.intersect1d(a, b, assume_unique=True))
                yes.append(100 * shared >= PERCENT * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays(
                [some.column("a"), some.column("b"), pa.array(yes, pa.bool_())], ["a", "b", "linked"]
            )


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``linked``, decided on whole texts."""
    a = texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))
    return materialized(
        pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(released(_linked), "a long, b long, linked boolean"),
        "verified",
    )


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("hash"), F.coalesce(F.octet_length(text), F.lit(-1)).alias("bytes")]


def _visits(state: DataFrame) -> DataFrame:
    """Members of open buckets, once for each pair of blocks they are compared in: ``block`` holds
    both numbers, ``own`` the member's. Blocks hold members of one size range, strays or others;
    they meet those of the same and the next ranges, unless neither has strays. So a task holds two
    blocks, whatever the bucket. Small buckets are one block."""
    width = F.least(F.lit(WIDE), F.greatest(F.lit(BLOCK), F.col("count") / 32))
    groups = state.where(F.col("size") > BLOCK).groupBy("key", "range", "stray").count()
    before = Window.partitionBy("key").orderBy("range", "stray").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("blocks", F.ceil(F.col("count") / width).cast("long"))
    groups = groups.withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0).cast("long")))
    # Two groups a size range: the array is bounded by the logarithm of the largest set.
    groups = groups.groupBy("key").agg(F.collect_list(F.struct("range", "stray", "first", "blocks")).alias("groups"))
    rows = state.join(bounded(groups, "40 * size(groups)"), "key", "left")
    mine = F.get(F.filter("groups", lambda g: (g["range"] == F.col("range")) & (g["stray"] == F.col("stray"))), F.lit(0))
    met = F.filter("groups", lambda g: (F.abs(g["range"] - F.col("range")) <= 1) & (g["stray"] | F.col("stray")))
    others = F.flatten(F.transform(met, lambda g: F.sequence(g["first"], g["first"] + g["blocks"] - 1)))
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("own", F.coalesce(mine["first"] + F.pmod(F.xxhash64("cid", "key"), mine["blocks"]), zero))
    rows = rows.withColumn("other", F.explode(F.coalesce(others, F.array(zero))))
    block = F.shiftleft(F.least("own", "other"), 32).bitwiseOR(F.greatest("own", "other"))
    return rows.select("key", "band", "cid", "component", "stray", "own", block.alias("block"))


def _links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Verified links between classes that keep all components: (u, v)."""
    size_range = F.floor(F.log(RANGE, F.col("n"))).cast("int").alias("range")
    keys = classes.select("cid", size_range, F.posexplode("keys").alias("band", "key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = materialized(keys.join(shared, "key"), "members")
    blocks = F.ceil(F.col("size") / BLOCK)
    dealt = members.withColumn("block", F.pmod(F.xxhash64("cid", "key"), blocks))
    signs = classes.select("cid", "n", "sign", "keys").join(small(members.select("cid").distinct()), "cid", "left_semi")
    signs = materialized(signs, "signs")
    found = materialized(_proposed(dealt.join(signs, "cid").select("key", "block", "cid", "n", "sign"), _forest), "pairs")

    wanted = classes.join(members.select("cid").distinct(), "cid", "left_semi").select("cid", "hash", "bytes", "rep")
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *_text_key(F.col(text_col)))
    wanted = small(materialized(wanted, "wanted").withColumnsRenamed({"hash": "h", "bytes": "n"}))
    texts = materialized(
        text.join(wanted, (F.col("hash") == F.col("h")) & (F.col("bytes") == F.col("n")) & F.col("id").eqNullSafe(F.col("rep")))
        .groupBy("cid").agg(F.min("text").alias("text")),
        "texts",
    )
    decided = _verified(found, texts)
    links = decided.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    parts = components(links).withColumnRenamed("node", "cid")

    # buckets that hold more than one component: all but the members of the largest are strays
    state = members.join(parts, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    by = state.groupBy("key", "component").agg(F.count("*").alias("c"))
    by = by.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("c", "component")).alias("main"))
    state = state.join(by.where("parts > 1").select("key", "main"), "key")
    state = state.withColumn("stray", F.col("component") != F.col("main")).drop("main")
    state = _visits(materialized(state, "open"))
    earlier = F.slice("keys", F.lit(1), F.col("band")).alias("earlier")
    more = _proposed(state.join(signs, "cid").select("key", "block", "own", "cid", "n", "sign", "component", "stray", earlier), _between)
    more = materialized(more.join(decided.select("a", "b"), ["a", "b"], "left_anti"), "more-pairs")
    again = _verified(more, texts).where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return links.unionByName(again)


def _signed_docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), *_text_key(text), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return materialized(
        rows.mapInArrow(
            released(_signed), f"id {kind}, hash long, bytes int, n long, low long, high long, keys array<long>, sign binary"
        ),
        "signed",
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept, and the key of its text."""
    signed = _signed_docs(docs, id_col, text_col)
    first = F.struct(F.col("id").isNull(), F.col("id"))
    classes = (
        signed.where("n > 0")
        .groupBy("low", "high", "n")
        .agg(
            F.min("id").alias("rep"),
            F.min_by(F.struct("hash", "bytes"), first).alias("text"),
            F.first("keys").alias("keys"),
            F.first("sign").alias("sign"),
        )
        .select("low", "high", "n", "rep", "text.*", "keys", "sign")
        .withColumn("cid", F.monotonically_increasing_id())
    )
    classes = materialized(classes, "classes")
    links = materialized(_links(docs, classes, id_col, text_col), "links")
    parts = components(links).withColumnRenamed("node", "cid")
    state = classes.select("cid", "low", "high", "n", "rep").join(parts, "cid", "left")
    state = state.withColumn("component", F.coalesce("component", "cid"))
    least = state.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = materialized(state.join(least, "component").select("low", "high", "n", "component_id"), "named")
    out = signed.select("id", "hash", "bytes", "n", "low", "high").join(named, ["low", "high", "n"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
        "hash",
        "bytes",
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with all their columns. Rows
    with the same id and text stay or go together (exact dedup before leaves one of them); rows of
    a component without any id all stay."""
    found = near_duplicates(docs, id_col, text_col)
    id_, hash_, bytes_ = (free(docs, n) for n in ("gone_id", "gone_hash", "gone_bytes"))
    names = {id_col: id_, "hash": hash_, "bytes": bytes_}
    gone = materialized(found.where("NOT kept").select(*names).withColumnsRenamed(names).distinct(), "gone")
    key, length = _text_key(F.col(text_col))
    same = (key == F.col(hash_)) & (length == F.col(bytes_)) & F.col(id_col).eqNullSafe(F.col(id_))
    return docs.join(small(gone), same, "left_anti")
