"""Benchmark passages against brute force over all windows."""

import random
from collections import Counter

from corpus_rows import sentence

from kymo.llm import decontaminate
from pyspark.sql import functions as F


def counts(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(docs, items):
    out = {}
    for i, text in docs:
        words = (text or "").lower().split()
        for item, passage in items:
            target = (passage or "").lower().split()
            k = min(5, len(target))
            if not target:
                continue
            want = counts(target, k)
            best = 0
            for s in range(max(len(words) - len(target), 0) + 1):
                have = counts(words[s : s + len(target)], k)
                both = sum((have & want).values())
                best = max(best, both / max(1, sum(have.values()) + sum(want.values()) - both))
            if best >= 0.75:
                out[(i, item)] = round(best, 6)
    return out


def test_matches_brute_force(spark):
    rnd = random.Random(6)
    items = [(i, sentence(rnd, n)) for i, n in enumerate((40, 25, 18, 60, 5, 3, 1, 30))]
    items += [(20, None), (21, ""), (22, items[0][1].upper()), (23, "again " * 12)]
    docs = [(0, None), (1, ""), (2, "  "), (3, "again " * 40), (4, items[5][1]), (5, items[1][1])]
    for i in range(60):
        words = items[i % 8][1].split()
        for _ in range(i // 12):  # edits: some leave the passage similar enough
            if not words:
                break
            at = rnd.randrange(len(words))
            words[at : at + 1] = rnd.choice([[], ["new"], [words[at], "more"]])
        docs.append((10 + i, f"{sentence(rnd, rnd.randint(0, 30))} {' '.join(words)} {sentence(rnd, rnd.randint(0, 30))}"))
    docs += [(200, sentence(rnd, 3000) + " " + items[3][1]), docs[20], docs[20], (None, "x " + items[0][1])]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, key string, leaked_key int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(d, b)
    assert {(r.doc_id, r.item_id): round(r.similarity, 6) for r in got.collect()} == brute(docs, items)
    left = decontaminate.drop_contaminated(d, b)
    assert left.columns == d.columns
    bad = {i for i, _ in brute(docs, items)}
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((i for i, _ in docs if i not in bad), key=str)
    assert decontaminate.contaminated(d.limit(0), b).count() == 0
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(d, b.where(F.col("item_id") == 20)).count() == len(docs)


def test_all_fingerprints_within_the_radius(spark):
    rnd = random.Random(8)
    base = [rnd.getrandbits(64) - (1 << 63) for _ in range(30)]
    near = []
    for i, x in enumerate(base):
        flips = rnd.sample(range(64), rnd.choice([0, 5, 22, 23, 24, 30]))
        y = (x + (1 << 63)) ^ sum(1 << f for f in flips)
        near.append((i, 7, y - (1 << 63)))
    a = spark.createDataFrame([(i, 7, x) for i, x in enumerate(base)], "iid long, size int, print long")
    b = spark.createDataFrame(near, "wid long, size int, print long")
    want = {
        (w, i)
        for w, _, y in near
        for i, x in enumerate(base)
        if ((x ^ y) & ((1 << 64) - 1)).bit_count() <= decontaminate.RADIUS
    }
    assert {(r.wid, r.iid) for r in decontaminate.within_radius(b, a).collect()} == want


def test_numbered_sets_intersect_as_multisets(spark):
    rnd = random.Random(9)
    rows = [([1], [1]), ([1, 2], [3]), ([5] * 7, [5] * 4), ([1, 2, 3], [3, 2, 1])]
    rows += [tuple([rnd.randint(-3, 3) for _ in range(rnd.randint(1, 20))] for _ in "ab") for _ in range(60)]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    a, b = (decontaminate.numbered(F.col(c)) for c in "ab")
    got = df.select("a", "b", F.size(F.array_intersect(a, b)).alias("both"), F.size(a).alias("n"), F.size(F.array_distinct(a)).alias("sets")).collect()
    assert all(r.both == sum((Counter(r.a) & Counter(r.b)).values()) and r.n == r.sets == len(r.a) for r in got)


def test_verification_deals_no_shingle_out_as_a_row(spark, monkeypatch):
    """Windows are dealt out as one array each: no exchange of the last step holds rows of a hash."""
    rnd = random.Random(10)
    items = [(i, sentence(rnd, 30)) for i in range(3)]
    docs = [(i, f"{sentence(rnd, 10)} {items[i % 3][1]} {sentence(rnd, 10)}") for i in range(9)]
    plans, stored = {}, decontaminate.materialized

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(decontaminate, "materialized", kept)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id): round(r.similarity, 6) for r in decontaminate.contaminated(d, b).collect()} == brute(docs, items)
    assert "Generate" not in plans["matches"] and plans["matches"].count("Aggregate") == 1
