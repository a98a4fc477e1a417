"""Rows of a small, awkward corpus."""

import random


def sentence(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def messy_rows(seed=5):
    """Copies, near copies, shared passages, NULLs, blanks, one very long text, repeated rows."""
    rnd = random.Random(seed)
    base = sentence(rnd, 90)
    passage = sentence(rnd, 40)
    texts = [base, base, base.replace(" ", "  "), base.upper(), base + " tail", None, "", " \n\t ", "one two three", "one two three"]
    for i in range(12):
        words = base.split(" ")
        words[(7 * i) % 80] = "edit"
        words[(5 * i + 3) % 80] = f"x{i}"
        texts.append(" ".join(words))
    texts += [f"{sentence(rnd, 30)} {passage} {sentence(rnd, 20 + i)}" for i in range(5)]
    texts += [sentence(rnd, 4000) + " " + passage, "a" * 400, "ab" * 300, "é" * 250, "ß" + passage]
    texts += [sentence(rnd, n) for n in (1, 3, 4, 5, 6, 20, 60)]
    rows = [(i, t, "en", "s", "d", i, 0.5, "t") for i, t in enumerate(texts)]
    rows += [rows[0], rows[20], (None, base, None, None, None, None, None, None), (None, "only without an id " * 9, None, None, None, None, None, None)]
    return rows
