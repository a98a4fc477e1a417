"""Medians of growing prefixes and the likelihood fit of the tail."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest

from kymo.operators.prefix_ranks import tree_levels
from kymo.plans import evaluation

D0 = dt.date(2000, 1, 1)


def test_tree_levels_hold_every_rank():
    for n in (0, 1, 2, 16, 17, 256, 257, 4096, 4097, 70_000):
        assert 16 ** tree_levels(n) >= n
    assert [tree_levels(n) for n in (1, 16, 17, 256, 257)] == [1, 1, 2, 2, 3]


def test_fold_normalise_equals_the_plain_definition(spark):
    draw = random.Random(5)
    data = {
        s: [
            (None if draw.random() < 0.2 else float(draw.randrange(9)), None if i < 40 else draw.gauss(0, 1))
            for i in range(n)
        ]
        for s, n in ((1, 300), (2, 33), (3, 5), (4, 32))
    }
    rows = [(s, D0 + dt.timedelta(days=i), *v) for s, vs in data.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "subject_id int, date date, a double, b double")
    got = {(r.subject_id, r.fold_idx): (r.a, r.b) for r in evaluation.fold_normalise(df, ["a", "b"], 30, 2).collect()}
    want = {}
    for s, vs in data.items():
        for i in range(32, len(vs)):
            out = []
            for c in (0, 1):
                past = [v[c] for v in vs[: i - 2] if v[c] is not None]
                if not past:
                    out.append(None)
                    continue
                m, d = statistics.median(past), float(np.std(past)) or 1.0
                out.append(((m if vs[i][c] is None else vs[i][c]) - m) / d)
            want[s, i - 32] = tuple(out)
    assert got.keys() == want.keys() and len(want) == 269
    for k, w in want.items():
        for g, x in zip(got[k], w):
            assert (g is None) == (x is None) and (x is None or g == pytest.approx(x, abs=1e-9)), k


def test_fold_normalise_on_an_empty_table(spark):
    df = spark.createDataFrame([], "subject_id int, date date, a double")
    assert evaluation.fold_normalise(df, ["a"]).collect() == []


def _excesses(shape, n=4000):
    u = np.random.default_rng(3).random(n)
    return (u**-shape - 1) / shape if shape else -np.log(u)


@pytest.mark.parametrize("shape", [-0.4, 0.0, 0.5])
def test_likelihood_finds_the_shape_and_a_flat_slope(spark, shape):
    x = _excesses(shape)
    df = spark.createDataFrame([(float(-v),) for v in x], "score double")
    fit = evaluation.pot_threshold(df, tail=1.0, method="likelihood").first()
    tail = fit.tail_threshold + x
    theta = fit["shape"] / fit.scale
    slope = (1 + np.log1p(theta * tail).mean()) * (1 / (1 + theta * tail)).mean() - 1
    assert abs(slope) < 1e-8 and fit.n_tail == len(x)
    assert fit["shape"] == pytest.approx(shape, abs=0.06) and fit.scale == pytest.approx(1.0, abs=0.08)


def test_likelihood_by_key_falls_back(spark):
    rows = [(1, float(i % 7)) for i in range(3)] + [(2, 4.0)] * 200 + [(3, float(i * i % 101)) for i in range(2000)]
    rows += [(4, None), (4, float("nan"))]
    df = spark.createDataFrame(rows, "k int, score double")
    got = {r.k: r for r in evaluation.pot_threshold(df, keys=["k"], method="likelihood").collect()}
    assert sorted(got) == [1, 2, 3]
    assert got[1]["shape"] is None and got[2]["shape"] is None and got[2].threshold == 4.0
    assert got[3].n_tail >= 5 and got[3].scale > 0
    with pytest.raises(ValueError, match="method"):
        evaluation.pot_threshold(df, method="mode")
