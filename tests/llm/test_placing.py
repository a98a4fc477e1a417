"""Sharding, packing and token counts."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kymo.llm import packing, sharding, token_counts
from corpus_rows import messy_rows

P = pytest.importorskip("public_tokenizers")


def least_capacity(sizes, shards):
    def fits(c):
        n, left = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > left:
                n, left = n + 1, c
            left -= s
        return n <= shards

    lo, hi = max([0, *sizes]), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


def check_shards(df, rows, shards):
    got = sharding.minimax_shards(df, shards).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows
    )
    slots, where = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        where[(r.size, r.text_crc32)].add(r.shard)
        assert 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())
    return got


def test_minimax_capacity_is_the_least(spark):
    rnd = random.Random(2)
    rows = [(i, "x" * rnd.choice([0, 3, 50, 400]) + str(rnd.randint(0, 300))) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    groups = df.selectExpr("xxhash64(text) as key", "octet_length(text) + 8L as size").groupBy("key").sum("size")
    ordered = [r[1] for r in sorted(groups.collect())]
    for shards in (1, 7, 24):
        got = check_shards(df, rows, shards)
        held = Counter()
        for r in got:
            held[r.shard] += r.size
        assert max(held.values()) == least_capacity(ordered, shards)


def test_a_hot_text_leaves_no_other_shard_empty(spark):
    rows = [(i, "hot text") for i in range(400)] + [(1000 + i, f"text {i}") for i in range(800)]
    got = check_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows, 6)
    assert {r.shard for r in got} == set(range(6))


def test_shards_defined_cases(messy, empty):
    check_shards(messy, messy_rows(), 24)
    assert sharding.minimax_shards(empty, 24).count() == 0


def brute_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def check_packing(df, rows, size):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = packing.pack_documents(df, P.path("word_bpe_49k.json"), size=size).collect()
    want = Counter()
    for r in rows:
        ids = brute_ids(tokenizer, r[1])
        for k, at in enumerate(range(0, len(ids), size)):
            piece = ids[at : at + size]
            want[(r[0], k, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= size
    best = packing.best_fit(np.array([r.length for r in got]), size)[2]
    return len(bins), len(best)


def test_packing(spark, messy, empty):
    bins, best = check_packing(messy, messy_rows(), 256)
    assert bins <= best + 1
    assert packing.pack_documents(empty, P.path("word_bpe_49k.json")).count() == 0


def test_packing_merges_over_a_tree(spark):
    """More partitions than one merge takes, each with a bin that only others can fill."""
    rows = [(i, "word " * (20 + i % 11)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(30)
    bins, best = check_packing(df, rows, 256)
    assert bins <= best + 1


def test_words_give_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    whole, words = Tokenizer.from_file(path), packing.WordIds(path)
    rnd = random.Random(1)
    texts = ["don't we'll \"I'm\" x's 12 3a4 İ Σας", "<|endoftext|> a<|endoftext|>b", "\x1c\x85\xa0 a　b ​", "ÿ µ ª º ×÷", "é ñ̃ ſ K Å"]
    texts += ["".join(rnd.choice("aAéÉß .,!'\"1\n\tΣς́<|>-") for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    for text, code in zip(texts, words.encode(texts), strict=True):
        assert np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes() == code, text


def test_words_that_return_are_not_encoded_again(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "WORDS", 20)
    path = P.path("word_bpe_49k.json")
    whole, coder = Tokenizer.from_file(path), packing.WordIds(path)
    learned, learn = [], coder._learn

    def counted(chunks):
        learned.extend(chunks)
        learn(chunks)

    monkeypatch.setattr(coder, "_learn", counted)
    for k in range(12):
        texts = [f"often OFTEN, {chr(97 + k)}one\n{chr(97 + k)}two, {k} rare{chr(97 + k)}. <{k}>", None, ""]
        for text, code in zip(texts, coder.encode(texts), strict=True):
            assert np.frombuffer(code, "<u4").tolist() == (whole.encode(text, add_special_tokens=False).ids if text else [])
        assert len(coder.known) + len(coder.older) <= 45
    assert learned.count("often") == learned.count("OFTEN") == learned.count(",") == 1


def test_best_fit_takes_the_fullest_bin():
    bins, offsets, fills = packing.best_fit(np.array([6, 7, 3, 4]), 10)
    assert bins.tolist() == [1, 0, 0, 1] and fills == [10, 10] and offsets.tolist() == [0, 0, 7, 6]


def coder():
    return token_counts.Offsets(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def brute_lines(offsets, text):
    text = text or ""
    lines = text.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
    data, at, first = text.encode(), 0, []
    for token in offsets.coder.encode_ordinary(text):
        n = offsets.sizes[token]
        chars = len(data[:at].decode(errors="ignore"))  # the character that the token's first byte is in
        first.append(chars)
        at += n
    out, start = [], 0
    for i, line in enumerate(lines):
        out.append((i, start, start + len(line), sum(start <= c < start + len(line) for c in first)))
        start += len(line)
    return out


def test_token_counts_of_lines(spark, messy, empty):
    offsets = coder()
    rows = [(1, "one\n\n two\nthree\n"), (2, "日本語\nテキスト \n\n x"), (3, None), (4, ""), (5, "\n"), (6, "no line feed"), (6, "no line feed")]
    rows += [(10 + i, r[1]) for i, r in enumerate(messy_rows())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_counts.section_tokens(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    want = Counter((i, *x) for i, t in rows for x in brute_lines(offsets, t))
    assert Counter((r.doc_id, r.section, r.char_start, r.char_end, r.n_tokens) for r in got) == want
    assert token_counts.section_tokens(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_token_rules(spark):
    first, last = np.array([0, 3, 8]), np.array([3, 8, 10])  # the second crosses 5
    s, e = np.array([0, 5]), np.array([5, 10])
    assert token_counts.attribute(first, last, s, e, "first").tolist() == [2, 1]
    assert token_counts.attribute(first, last, s, e, "most").tolist() == [1, 2]
    assert token_counts.attribute(first, last, s, e, "share").tolist() == pytest.approx([1.4, 1.6])
    df = spark.createDataFrame(
        [(1, "some words and more", [("a", 0, 5), ("b", 5, 99), (None, 7, 7)]), (2, None, [("a", 0, 5)]), (3, "text", None)],
        "doc_id long, text string, parts array<struct<name:string,start:int,end:int>>",
    )
    for rule in token_counts.RULES:
        out = token_counts.section_tokens(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, sections_col="parts", rule=rule).collect()
        assert [(r.doc_id, r.name, r.char_end) for r in out] == [(1, "a", 5), (1, "b", 19), (1, None, 7), (2, "a", 0)]
        assert sum(r.n_tokens for r in out) == pytest.approx(4) and out[2].n_tokens == 0
