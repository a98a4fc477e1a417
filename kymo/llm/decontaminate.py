"""Benchmark passages in documents, in DataFrame functions only.

A window of a document has as many words as the benchmark item it is held against. Its SimHash, and
that of every item, is cut into ``RADIUS`` + 1 blocks: two fingerprints at most ``RADIUS`` bits
apart agree on one block at least, so an equality join on (size, block) finds all of them. Each
candidate is verified by the weighted Jaccard similarity of word shingles, weighted by how often
a shingle occurs.

Which windows are looked at is exact: a window can only reach the threshold if it shares a shingle
with an item of its size, and moving it to the right until it begins with such a shingle loses
none; at the end of a document it stops with the last word. Documents shorter than an item are one
window. Windows with the same words are handled once, whatever the number of documents.

At a similarity of 0.75 the expected distance is 11 of 64 bits with a deviation of 3; 23 bits are
four deviations above it.

Defined cases: NULL, empty and blank texts and items have no window and no match; an item with fewer
than five words is one shingle; equal items match alike; repeated rows match alike; NULL ids are
kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymo.llm.frames import bounded, free, settle, small
from kymo.session import materialized

SHINGLE, SIMILARITY, RADIUS, BITS = 5, 0.75, 23, 64


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(w: Column, k: int) -> Column:
    """Hashes of all runs of k words, in order."""
    return F.when(
        F.size(w) >= k,
        F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])),
    )


def numbered(shingles: Column) -> Column:
    """The hashes without order, the second and later of equal ones mixed with their number, so that
    the intersection of two such sets counts the smaller number of each hash."""

    def let(x: Column, f: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(x), f), F.lit(0))

    def of(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(first, lambda at: F.flatten(F.transform(at, lambda i, n: run(s, i, F.coalesce(F.get(at, n + 1), F.size(s)) - i))))

    def run(s: Column, i: Column, count: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), count - 1), lambda j: F.when(j == 0, F.get(s, i)).otherwise(F.xxhash64(F.get(s, i), j)))

    repeats = F.size(F.array_distinct(shingles)) < F.size(shingles)
    return F.when(repeats, let(F.array_sort(shingles), of)).otherwise(shingles)


def simhash(rows: DataFrame, keys: list[str], shingles: str) -> DataFrame:
    """Fingerprint of each row's shingles: bit b is set if more than half of the hashes have it.
    Sixteen sums hold the 64 counts, four to a sum (of items above 65,535 shingles the counts are
    taken modulo 2^16, so that equal windows still agree)."""
    lanes = 0x0001000100010001
    lane = [F.shiftrightunsigned("h", j).bitwiseAND(F.lit(lanes)) for j in range(16)]
    sums = (
        rows.select(*keys, F.explode(shingles).alias("h"))
        .groupBy(*keys)
        .agg(F.count("*").alias("m"), *[F.sum(x).alias(f"s{j}") for j, x in enumerate(lane)])
    )
    bit = [
        F.when(F.shiftrightunsigned(f"s{j}", 16 * at).bitwiseAND(F.lit(0xFFFF)) * 2 > F.col("m"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0))
        for j in range(16)
        for at in range(4)
        for b in [16 * at + j]
    ]
    return sums.select(*keys, "m", reduce(lambda a, b: a.bitwiseOR(b), bit).cast("long").alias("print"))


def blocks(fingerprint: str) -> Column:
    """The fingerprint's blocks, as (number, value)."""
    cut = [BITS * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("number"),
                F.shiftrightunsigned(fingerprint, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value"),
            )
            for i, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False))
        ]
    )


def within_radius(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` and ``b`` with the same size whose fingerprints are at most ``RADIUS`` bits
    apart: (wid, iid). Both have size, print and their id."""
    left = a.select("wid", "size", "print", F.explode(blocks("print")).alias("block"))
    right = b.select("iid", F.col("size").alias("z"), F.col("print").alias("q"), F.explode(blocks("print")).alias("c"))
    same = (F.col("size") == F.col("z")) & (F.col("block.number") == F.col("c.number")) & (F.col("block.value") == F.col("c.value"))
    close = F.bit_count(F.col("print").bitwiseXOR(F.col("q"))) <= RADIUS
    return left.join(small(right), same).where(close).select("wid", "iid").distinct()


def _items(benchmark: DataFrame, text_col: str) -> DataFrame:
    """Distinct items with a word: iid, size, k (words a shingle), shingles."""
    w = benchmark.select(words(F.col(text_col)).alias("w")).where(F.size("w") > 0).distinct()
    made = w.select(
        F.xxhash64(F.array_join("w", " ")).alias("iid"),
        F.size("w").alias("size"),
        F.least(F.size("w"), F.lit(SHINGLE)).alias("k"),
        F.coalesce(*[F.when(F.least(F.size("w"), F.lit(SHINGLE)) == k, shingle_hashes(F.col("w"), k)) for k in range(1, SHINGLE + 1)]).alias("shingles"),
    )
    return materialized(made, "items")


def _windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Where windows begin: distinct (key, size, k, start). ``docs``: key, w."""
    out = []
    for k in sorted(r.k for r in items.select("k").distinct().collect()):  # at most five values
        seeds = materialized(items.where(F.col("k") == k).select("size", F.explode("shingles").alias("h")).distinct(), "seeds")
        found = (
            docs.select("key", F.size("w").alias("n"), F.posexplode(shingle_hashes(F.col("w"), k)).alias("pos", "h"))
            .join(small(seeds), "h")
            .select("key", "size", F.lit(k).alias("k"), F.least("pos", F.greatest(F.col("n") - F.col("size"), F.lit(0))).alias("start"))
        )
        out.append(found)
    return reduce(DataFrame.unionByName, out).distinct() if out else None


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text: str = "text") -> DataFrame:
    """Contaminated texts: key (hash of the text), iid (hash of the item's words), similarity of
    the best window, start (its first word)."""
    spark = docs.sparkSession
    settle(spark)  # its plans are the largest of the library
    items = _items(benchmark, item_text)
    text = docs.select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    starts = _windows(text.select("key", words(F.col("text")).alias("w")), items)
    if starts is None:
        return spark.createDataFrame([], "key long, iid long, similarity double, start int")
    starts = materialized(starts, "windows")
    hits = small(starts.select("key").distinct())
    texts = materialized(text.join(hits, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text")), "hit-texts")
    w = texts.select("key", words(F.col("text")).alias("w"))
    hashed = F.coalesce(*[F.when(F.col("k") == k, shingle_hashes(F.col("w"), k)) for k in range(1, SHINGLE + 1)])
    by_k = w.join(starts.select("key", "k").distinct(), "key").select("key", "k", hashed.alias("all"))
    cut = F.slice("all", F.col("start") + 1, F.col("size") - F.col("k") + 1)
    placed = materialized(
        starts.join(by_k, ["key", "k"]).select("key", "size", "start", cut.alias("shingles")).withColumn("wid", F.xxhash64("size", "shingles")),
        "placed",
    )
    distinct = materialized(placed.groupBy("wid", "size").agg(F.min("shingles").alias("shingles")), "distinct-windows")
    prints = materialized(simhash(items, ["iid", "size"], "shingles"), "item-prints")
    candidates = materialized(within_radius(simhash(distinct, ["wid", "size"], "shingles"), prints), "candidates")
    settle(spark)

    # weighted Jaccard: sum of the smaller counts over sum of the larger
    wanted = items.select("iid", F.size("shingles").alias("mi"), numbered(F.col("shingles")).alias("wanted"))
    wanted = bounded(materialized(wanted, "item-sets"), "8 * mi")
    both = F.size(F.array_intersect("had", "wanted"))
    verified = (
        distinct.select("wid", F.size("shingles").alias("m"), numbered(F.col("shingles")).alias("had"))
        .join(candidates, "wid")
        .join(wanted, "iid")
        .select("wid", "iid", "m", "mi", both.alias("both"))
        .select("wid", "iid", (F.col("both") / (F.col("m") + F.col("mi") - F.col("both"))).alias("similarity"))
        .where(F.col("similarity") >= SIMILARITY)
    )
    best = placed.select("key", "start", "wid").join(verified, "wid").groupBy("key", "iid")
    return materialized(
        best.agg(F.max("similarity").alias("similarity"), F.min_by("start", F.struct(-F.col("similarity"), "start")).alias("start")), "matches"
    )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document and item that it holds: id, item, similarity, start."""
    found = matches(docs, benchmark, text_col, item_text)
    named = benchmark.select(F.col(item_col), F.xxhash64(F.array_join(words(F.col(item_text)), " ")).alias("iid"))
    rows = docs.select(F.col(id_col), F.xxhash64(text_col).alias("key"))
    return rows.join(found, "key").join(small(named), "iid").select(id_col, item_col, "similarity", "start")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a benchmark passage, with all their columns."""
    name = free(docs, "leaked_key")
    keys = materialized(matches(docs, benchmark, text_col, item_text).select(F.col("key").alias(name)).distinct(), "leaked")
    return docs.join(small(keys), F.xxhash64(text_col) == F.col(name), "left_anti")
