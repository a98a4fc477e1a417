"""Reply trees: paths, ranks, and an exact round trip of the template."""

import random

import pytest

from kymo.llm import chat
from pyspark.sql import functions as F


def frame(spark, rows):
    return spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")


def test_branches_are_ranked_by_score(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0),
        (1, 2, 1, "assistant", "good", 3.0),
        (1, 3, 1, "assistant", "bad", 1.0),
        (1, 4, 2, "user", "more", 0.0),
        (1, 5, 3, "user", "other", 0.0),
        (1, 6, 4, "assistant", "end", 2.0),
        (2, 1, 99, "user", "parent is missing", None),
        (3, 1, 2, "user", "on a cycle", 1.0),
        (3, 2, 1, "user", "on a cycle", 1.0),
        (None, 1, None, "user", "no tree", 1.0),
        (1, 6, 4, "assistant", "end", 2.0),
        (1, None, 4, "assistant", "no node", 2.0),
    ]
    got = chat.best_paths(chat.one_each(frame(spark, rows)), branches=2).collect()
    paths = {}
    for r in sorted(got, key=lambda r: -r.back):
        paths.setdefault((r.tree, r.branch), []).append(r.node)
    assert paths == {(1, 1): [1, 2, 4, 6], (1, 2): [1, 3, 5], (2, 1): [1], (None, 1): [1]}


def test_long_chains_and_odd_texts_come_back(spark):
    rnd = random.Random(4)
    marks = ["###", "### Assistant: ", "</turn>", "</turn>\n", "\\", "\\h", "\\\\l", "<", "#", ":", "\n", " ", "é", "日本", "\0", ""]
    rows, want = [], {}
    for tree, depth in ((1, 300), (2, 1), (3, 2), (4, 7)):
        for n in range(1, depth + 1):
            text = None if n % 50 == 7 else "".join(rnd.choice(marks) for _ in range(rnd.randint(0, 6)))
            role = rnd.choice(["user", "assistant", "a: b#<\\c", None])
            rows.append((tree, n, n - 1 if n > 1 else None, role, text, 0.0))
            want.setdefault(tree, []).append((role or "", text or ""))
    rnd.shuffle(rows)
    out = chat.format_conversations(frame(spark, rows)).withColumns(
        {"turns": chat.read_turns(F.col("formatted")), "learned": chat.read_loss(F.col("formatted"), F.col("loss"))}
    )
    got = {r.tree: r for r in out.collect()}
    assert {t: [tuple(x) for x in r.turns] for t, r in got.items()} == want
    for tree, turns in want.items():
        assert got[tree].learned == "".join(t for role, t in turns if role == "assistant")


def test_linear_replies(spark):
    rows = spark.createDataFrame(
        [(1, 2, "user", "c"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, None, "system", "first"), (1, 2, "user", "c"), (None, 0, "user", "x")],
        "conv_id long, turn long, role string, text string",
    )
    out = chat.format_conversations(chat.linear_replies(rows)).select("tree", chat.read_turns(F.col("formatted")).alias("t"))
    assert {r.tree: [x.text for x in r.t] for r in out.collect()} == {1: ["first", "a", "b", "c", "c"], None: ["x"]}
    assert chat.format_conversations(chat.linear_replies(rows.limit(0))).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "\\b", "#<:\\c\\\\", "</turn>\n### x: y"])
def test_escape_is_undone(spark, text):
    row = spark.range(1).select(chat.escape(F.lit(text)).alias("a"), chat.escape(F.lit(text), role=True).alias("b"))
    a, b = row.first()
    assert not set("#<") & set(a) and not set("#<:") & set(b)
    assert row.select(chat.unescape(F.col("a")), chat.unescape(F.col("b"))).first() == (text, text)
