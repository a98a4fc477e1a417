"""SimHash trie, spelling variants and filter audit against brute force."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
import xxhash
from corpus_rows import messy_rows

from kymo.llm import catalog, filter_audit, simhash_dedup, spelling
from kymo.llm.simhash_dedup import Forest, trie_links, walk

DATA = "/root/testdata/sf0.001"
mounted = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not mounted")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# ---- fingerprints and their links -------------------------------------------------------------


def slow_fingerprint(t):
    w = words(lower(t))
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    codes = [xxhash.xxh64_intdigest(r.encode("utf-8", "surrogatepass"), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def brute_components(rows):
    codes = [(i, slow_fingerprint(t)) for i, t in rows]
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(codes):
        for j in range(i):
            if (a ^ codes[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(codes):
        if doc is not None:
            least[find(i)].append(doc)
    alone = Counter(find(i) for i in range(len(codes)))
    return [
        (doc, f"{fp:016x}", min(least[find(i)], default=None) if alone[find(i)] > 1 else doc)
        for i, (doc, fp) in enumerate(codes)
    ]


def simhash_rows(df):
    rows = simhash_dedup.near_duplicates(df).collect()
    return [(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in rows]


def test_simhash_on_messy_rows(messy, empty):
    want = brute_components([(r[0], r[1]) for r in messy_rows()])
    assert sorted(simhash_rows(messy), key=str) == sorted(want, key=str)
    assert simhash_dedup.near_duplicates(empty).count() == 0


@mounted
def test_simhash_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    got = [tuple(r) for r in catalog.op11_simhash_trie(spark, DATA).collect()]
    assert sorted(got) == sorted(want)


def test_fingerprint_of_a_very_long_text(monkeypatch):
    rnd = random.Random(3)
    text = " ".join(rnd.choice("abcdefg") for _ in range(3000))
    whole = simhash_dedup.fingerprint(text)
    assert whole == slow_fingerprint(text)
    monkeypatch.setattr(simhash_dedup, "CHUNK", 97)
    assert simhash_dedup.fingerprint(text) == whole
    assert simhash_dedup.fingerprint(None) == simhash_dedup.fingerprint(" \n") == 0


def planted(n, seed=1):
    """Random fingerprints, a ball of near ones, and some at the edge of the radius."""
    rnd = random.Random(seed)
    codes = {rnd.getrandbits(64) for _ in range(n)}
    centre = rnd.getrandbits(64)
    for _ in range(n // 2):
        code = centre
        for b in rnd.sample(range(64), rnd.randint(1, 4)):
            code ^= 1 << b
        codes.add(code)
    for code in rnd.sample(sorted(codes), 40):
        for k in (3, 4):
            far = code
            for b in rnd.sample(range(64), k):
                far ^= 1 << b
            codes.add(far)
    return np.array(sorted(codes), np.uint64)


@pytest.mark.parametrize("front", [7, 65_536])
def test_walk_finds_all_pairs(monkeypatch, front):
    monkeypatch.setattr(simhash_dedup, "FRONT", front)
    codes = planted(150)
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3
    want = {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j}
    found = [(i, j) for a, b in walk(codes, None, 0, 0) for i, j in zip(a, b, strict=True)]
    assert set(found) == want and len(found) == len(want)
    low, high = codes[codes < 1 << 63], codes[codes >= 1 << 63]
    split = {(low[i], high[j]) for a, b in walk(low, high, 1, 1) for i, j in zip(a, b, strict=True)}
    assert split == {(codes[i], codes[j]) for i, j in want if codes[i] < 1 << 63 <= codes[j]}


def test_trie_links_connect_the_same_components(spark):
    codes = planted(300)
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3
    want, got = Forest(len(codes)), Forest(len(codes))
    want.join(*np.nonzero(near))
    place = {int(c): k for k, c in enumerate(codes.view(np.int64))}
    leaves = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    links = trie_links(leaves, share=25).collect()  # a crowded ball, opened many bits deep
    got.join(np.array([place[r.u] for r in links]), np.array([place[r.v] for r in links]))
    assert (want.root == got.root).all()
    assert trie_links(leaves, share=len(codes)).count() == len(codes) - len(set(want.root))  # one pair of nodes, a forest


# ---- spelling ----------------------------------------------------------------------------------


def slow_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [x for x in n if slow_edit(w, x)] for w in n}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def variant_rows(seed=2):
    """Frequent words, their misspellings, chains of forms, ties, long runs, accents, anagrams."""
    rnd = random.Random(seed)
    stems = ["kastanie", "kastanien", "verbündete", "information", "x" * 30, "x" * 29 + "y", "abcdefg" * 4]
    said = []
    for w in stems:
        said += [w] * rnd.randint(30, 60)
        for _ in range(25):
            at, c = rnd.randrange(len(w)), rnd.choice("aeixyzüß")
            said += [rnd.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]])] * 2
    said += ["chained"] * 400 + ["chainedx"] * 40 + ["chainedxy"] * 4 + ["mittels"] * 20 + ["mittelx"] * 2 + ["mittely"] * 20
    said += ["".join(rnd.sample("abcdefgh", 8)) for _ in range(300)] * 2
    rnd.shuffle(said)
    rows = [(i, " ".join(w.upper() if rnd.random() < 0.2 else w for w in said[i * 50 : i * 50 + 50])) for i in range(len(said) // 50 + 1)]
    rows += [(None, "kastanie information-information"), (None, None), (7, ""), rows[0], (900, "z" * 5000 + " " + "z" * 5000)]
    return [(i, t) for i, t in rows]


@pytest.mark.parametrize("subtree", [40, 50_000])
def test_spelling_variants(spark, subtree):
    rows = variant_rows()
    df = spark.createDataFrame([(*r, "n", "w") for r in rows], "doc_id long, text string, n string, word string").repartition(3)
    got = [tuple(r) for r in spelling.spelling_variants(df, subtree=subtree).collect()]
    assert sorted(got, key=lambda r: r[0]) == brute_variants(rows)
    assert max(r[4] for r in got) > 10 and sum(r[1] is not None for r in got) > 20


def test_spelling_variants_of_nothing(messy, empty):
    assert spelling.spelling_variants(empty).count() == 0
    got = sorted(tuple(r) for r in spelling.spelling_variants(messy).select("word", "n").collect())
    assert got == [(r[0], r[3]) for r in brute_variants([(r[0], r[1]) for r in messy_rows()])]


def test_search_spends_both_budgets():
    rnd = random.Random(4)
    base = ["".join(rnd.choice("etaoinéü") for _ in range(rnd.randint(7, 9))) for _ in range(400)]
    base = sorted(set(base + [w[:3] + "x" + w[4:] for w in base] + [w[1:] for w in base if len(w) > 7] + ["abcdefghij" * 4, "abcdefghij" * 4 + "k"]))
    trie = spelling.Spellings(base, np.ones(len(base), np.int64), ordered=True)
    found = {(trie.words[i], trie.words[j]) for x, y in spelling.search(trie, trie) for i, j in zip(x, y, strict=True)}
    assert found == {(a, b) for a in base for b in base if slow_edit(a, b)}


# ---- filter audit -------------------------------------------------------------------------------


def brute_audit(rows, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1} for k in (0, 1))
    first = {}
    for doc, text, _ in rows:
        if doc is not None:
            first[text or ""] = min(first.get(text or "", doc), doc)
    fails = []
    for doc, text, source in rows:
        t = text or ""
        w = words(t)
        f = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": doc is not None and doc > first[t],
        }
        fails.append((source or "", doc, {k for k, v in f.items() if v}))
    out = []
    for part in {p for p, _, _ in fails}:
        mine = [(d, f) for p, d, f in fails if p == part]
        shapley = Counter()
        steps = []
        for order in permutations("ABCDE"):
            gone = set()
            for k, f in enumerate(order):
                left = [(d, x) for d, x in mine if not x & gone]
                now = [d for d, x in left if f in x]
                shapley[f] += len(now)
                steps.append((
                    part, "".join(order), k + 1, len(left) - len(now), len(now), sum(f in x and bool(x & gone) for _, x in mine),
                    sum(x == {f} for _, x in mine), sum(d in good for d in now), sum(d in toxic for d in now), f,
                ))
                gone.add(f)
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


def test_filter_audit(spark, messy, empty):
    rnd = random.Random(6)
    rows = [(i, t, rnd.choice(["s", "t", "", None])) for i, t, *_ in messy_rows()]
    long = " ".join(f"w{k}" for k in range(260))
    rows += [(1000 + k, long + " #" * (k % 2) + " SHOUT" * (k % 3 * 20), "s") for k in range(9)]
    rows += [(2000, "a b " * 150, "t"), (2001, "a b " * 150, "u"), (2001, "a b " * 150, "u"), (2001, "other", "u")]
    labels = [(1000 + k, k % 2, int(k % 3 == 0)) for k in range(9)] + [(2001, 1, 1), (2001, 0, None), (None, 1, 1), (77_777, 1, 1), (0, None, 1)]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, source string, key int, alive boolean").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(df, known)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in found.collect()) == brute_audit(rows, [x for x in labels if x[0] is not None])
    assert filter_audit.audit(empty, known).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("audit_")]


def test_audit_joins_without_shuffling_ids(spark):
    """The joins of a level read buckets; only counts by part are exchanged."""
    tables = filter_audit._Relations(spark, 4)
    state = spark.range(5000).selectExpr("id AS key", "'s' AS part", "true AS good", "false AS toxic", "'' AS prefix", "true AS alive")
    failing = spark.range(0, 5000, 3).selectExpr("id AS failed", "'A' AS filter")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        failing = tables.store(failing, "failing", "failed", by=["filter"])
        state = tables.store(state, "documents", "key")
        plan = filter_audit._counts(state, failing)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and "hashpartitioning(key" not in plan and "hashpartitioning(failed" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        tables.close()


def test_audit_writes_a_bucket_once(spark, monkeypatch):
    """Where a cluster deals rows out to more partitions than there are buckets, files do not multiply."""
    rows = [(i, f"text {i % 70} {'#' * (i % 2)} {'LOUD' * (i % 3)}", "s") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    known = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    files, store = {}, filter_audit._Relations.store

    def counted(self, df, name, *rest, **more):
        out = store(self, df, name, *rest, **more)
        files[name] = len(out.inputFiles()), self.buckets
        return out

    monkeypatch.setattr(filter_audit._Relations, "store", counted)
    for name in ("repartition", "repartitionByRange"):
        deal = getattr(type(df), name)
        monkeypatch.setattr(type(df), name, lambda self, n, *cols, deal=deal: deal(self, max(60, n) if cols else n, *cols))
    assert sorted(tuple(r) for r in filter_audit.audit(df, known).collect()) == brute_audit(rows, [(1, 1, 0)])
    assert files["documents"][0] <= files["documents"][1] and files["failing"][0] <= 5 * files["failing"][1], files
