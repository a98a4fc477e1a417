"""Exact, near and repeated-string deduplication against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from kymo.llm import exact_dedup, near_dedup, suffix_dedup
from kymo.llm.components import components
from kymo.llm.exact_dedup import DigestIndex
from kymo.session import stage_path
from corpus_rows import messy_rows


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_duplicates(messy):
    rows = messy_rows()
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r[0])
    want = []
    for r in rows:
        ids = groups[normal(r[1])]
        keep = min((i for i in ids if i is not None), default=None)
        want.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256(normal(r[1]).encode()).hexdigest()))
    for batches in (1, 3):
        got = [tuple(r) for r in exact_dedup.exact_duplicates(messy, batches=batches).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_exact_drop_keeps_one_row_and_all_columns(messy, empty):
    left = exact_dedup.drop_duplicates(messy)
    assert left.columns == messy.columns
    got = [normal(r.text) for r in left.collect()]
    assert sorted(got) == sorted({normal(r[1]) for r in messy_rows()})
    assert exact_dedup.drop_duplicates(empty).count() == 0


def test_digest_index_outlives_the_batch_and_the_table(spark):
    path = stage_path(spark, "index")
    first = spark.createDataFrame([(5, "a b"), (9, "c")], "doc_id long, text string")
    exact_dedup.exact_duplicates(first, DigestIndex(spark, path, buckets=4)).collect()
    index = DigestIndex(spark, path, buckets=4)
    spark.sql(f"DROP TABLE {index.table}")  # a new session has the files only
    again = DigestIndex(spark, path, buckets=4)
    second = spark.createDataFrame([(11, "a  b"), (12, "new"), (12, "new")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_duplicates(second, again).collect()}
    assert got == {(11, 5, False), (12, 12, True)}
    assert again.entries().count() == 3
    exact_dedup.exact_duplicates(second, again).collect()  # a batch that comes again
    assert again.entries().count() == 3


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        keep = r[0] if not sets[i] else min(ids, default=None)
        out.append((r[0], len(sets[i]), keep, r[0] == keep))
    return sorted(out, key=str)


def near(df):
    return sorted(map(tuple, near_dedup.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_near_duplicates(messy, empty):
    assert near(messy) == brute_components(messy_rows())
    assert near(empty) == []


def test_near_duplicates_over_many_blocks(spark, monkeypatch):
    """A chain of near copies, far larger than a block, whose ends have little in common."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words)))
        words[(i * 3) % 120] = f"new{i}"
    rows += [(100 + i, " ".join(f"q{i}x{j}" for j in range(30))) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert near(df) == brute_components(rows)


def test_open_pair_whose_low_bytes_agree_in_an_earlier_band():
    """Only keys tell which buckets two members share: here band 0 agrees in its low bytes alone."""
    sign = np.ones((2, near_dedup.COORDINATES), np.uint8)
    rows = {"cid": np.array([5, 9]), "n": np.array([50, 50]), "component": np.array([5, 9]), "stray": np.array([False, True])}
    rows |= {"block": np.zeros(2, int), "own": np.zeros(2, int), "band": np.ones(2, int)}
    keys = lambda *k: np.fromiter(map(np.array, k), object, len(k))
    assert sorted(near_dedup._between(sign, rows | {"earlier": keys([1], [2])})[0]) == [5, 9]
    assert near_dedup._between(sign, rows | {"earlier": keys([1], [1])}) == []  # counted in band 0
    assert sorted(near_dedup._between(sign, rows | {"earlier": keys([], [])})[0]) == [5, 9]


def test_open_members_of_a_hot_bucket_are_spread(spark, monkeypatch):
    """A template whose texts do not link one another, but a few near copies in other blocks and
    other size ranges: no group holds more than two blocks, and no link is lost."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    largest, proposed = [], near_dedup._proposed

    def seen(rows, propose):
        largest.append(rows.groupBy("key", "block").count().agg({"count": "max"}).first()[0])
        return proposed(rows, propose)

    monkeypatch.setattr(near_dedup, "_proposed", seen)
    common = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(common + [f"own{i}x{j}" for j in range(29 + i % 9)])) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + "".join(f" more{i}x{j}" for j in range(i))) for i in range(1, 40, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert near(df) == brute_components(rows)
    assert len(largest) == 2 and max(largest) <= 80, largest


def test_near_drop(messy):
    left = near_dedup.drop_near_duplicates(messy)
    assert left.columns == messy.columns
    want = sorted(r[0] for r in brute_components(messy_rows()) if r[3] and r[0] is not None)
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == want


def test_circulant_signatures_estimate_jaccard():
    rng = np.random.default_rng(3)
    common = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    a = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 100).astype(np.uint64)]))
    b = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 100).astype(np.uint64)]))
    s = near_dedup.circulant_signatures([a, b])
    assert abs((s[0] == s[1]).mean() - 900 / 1100) < 0.1
    assert (near_dedup.circulant_signatures([a])[0] == s[0]).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (5, 200), (7, 7)]
    got = dict(components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {**dict.fromkeys([*range(31), 200], 0), 100: 100, 101: 100, 102: 100}


def brute_repeats(rows, length):
    """Documents in order of id; equal (id, text) rows count once."""
    once = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = set(), {}
    for i, t in once:
        raw = (t or "").encode()
        covered = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                covered[p : p + length] = b"\1" * length
            seen.add(s)
        spans = sum(c and (not j or not covered[j - 1]) for j, c in enumerate(covered))
        kept = bytes(b for b, c in zip(raw, covered, strict=True) if not c)
        out[(i, t)] = (len(raw), sum(covered), spans, kept)
    return out


def repeats(df, length):
    got = {}
    for r in suffix_dedup.remove_repeats(df, length).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
        spans = r.spans or []
        got[(r.doc_id, r.text)] = (r.n_bytes, sum(s.end - s.start for s in spans), len(spans), bytes(r.kept))
    return got


@pytest.mark.parametrize("length", [100, 50])
@pytest.mark.parametrize("shard", [1, 3000, 1 << 25])
def test_repeats(spark, monkeypatch, length, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 1 << 12)
    # the two documents without an id would have no order of their own
    rows = [r for r in messy_rows() if r[0] is not None]
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").repartition(3)
    assert repeats(df, length) == brute_repeats(rows, length)


def test_repeats_of_edges_and_periods(spark):
    import random

    rnd = random.Random(11)
    pool = ["".join(rnd.choice("ab \n") for _ in range(rnd.randint(90, 260))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rnd.choice(pool)[rnd.randint(0, 40) :] for _ in range(rnd.randint(1, 3))]
        rows.append((i, rnd.choice(["", "x", "zz"]).join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert repeats(df, 100) == brute_repeats(rows, 100)


def test_repeats_defined_cases(spark, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    text = "the same text of more than a hundred bytes, " * 4 + "end"
    df = spark.createDataFrame([(None, text), (3, text), (3, text), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, len(r.kept)) for r in suffix_dedup.remove_repeats(df).collect())
    kept = len(brute_repeats([(3, text)], 100)[(3, text)][3])
    assert got == [(False, 3, kept), (False, 3, kept), (False, 4, 0), (True, 0, 0)]
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(df.selectExpr("cast(doc_id as string) as doc_id", "text"))


def test_interleave_finds_repeated_intervals_and_prefixes():
    rng = np.random.default_rng(1)
    slices = [np.sort(rng.integers(0, 1 << 63, 50).astype(np.uint64)) for _ in range(4)]
    shared = slices[0][10]
    slices[2] = np.sort(np.append(slices[2], shared))
    prefix_only = shared ^ np.uint64(1)  # same suffix symbols, another preceding one
    slices[3] = np.sort(np.append(slices[3], prefix_only))
    repeated, prefix = suffix_dedup.interleave(slices)
    rows = np.concatenate(slices)
    assert set(rows[repeated]) == {shared}
    assert (prefix[rows == prefix_only] == 2).all()


def test_merge_gives_back_its_memory(monkeypatch):
    import random

    import pyarrow as pa

    from kymo.llm import suffix_dedup

    given = []
    monkeypatch.setattr(suffix_dedup, "give_back", lambda: given.append(1))
    rng = random.Random(4)
    common, own = ("".join(rng.choices("abcdefgh", k=n)) for n in (400, 300))
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3], "text": [common, own + common, own[::-1]]})
    slices = pa.Table.from_batches(list(suffix_dedup._transforms(100, 0)(iter([batch]))))
    assert set(suffix_dedup._merged(slices).column("id").to_pylist()) == {1, 2}
    assert given == [1]
