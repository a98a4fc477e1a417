"""Boosted trees, the guided search and Shapley values."""

import math
import os
import time
from itertools import combinations

import numpy as np
import pytest

from kymo.catalog import models
from kymo.catalog.registry import ENTRIES
from kymo.fixtures import Views
from kymo.plans import boosting, histograms, shapley
from kymo.plans.features import HRV_FEATURES
from kymo.plans.histograms import best_split
from kymo.plans.search import MedianPruner, ParzenSearch, drawn

DATA = "/root/testdata/sf0.001"
mounted = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not mounted")


@mounted
def test_registered_boosting_uses_all_features_and_default_rounds(spark):
    model = models._boosted(Views(spark, DATA))
    assert model.cols == HRV_FEATURES and len(model.cols) == 29
    assert model.params == boosting.DEFAULTS and model.params["rounds"] == 500 and model.params["patience"] == 20
    assert 1 <= len(model.trees) <= 500


@mounted
def test_registered_search_covers_the_ranges(spark, monkeypatch):
    seen = []

    def search(df, cols, y, *rest, **more):
        seen.append((list(cols), rest, more))
        return [({"max_depth": 2, "rounds": 1}, 0.0)]

    monkeypatch.setattr(boosting, "param_search", search)
    ENTRIES["param_search"].build(Views(spark, DATA))
    assert seen == [(HRV_FEATURES, (), {})]  # 100 trials, three folds, all ranges, default rounds
    for name, (low, high, _) in boosting.RANGES.items():
        values = [s[name] for s in drawn(100, boosting.RANGES)]
        assert low <= min(values) < low + 0.4 * (high - low) and high - 0.4 * (high - low) < max(values) <= high


def made_up(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = np.sin(2 * x[:, 0]) + 0.5 * (x[:, 1] > 0) + 0.1 * rng.normal(size=n)
    rows = [(i % 6, i // 6, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "subject_id int, day int, a double, b double, c double, y double")
    return df.selectExpr("subject_id", "date_add(DATE '2024-01-01', day) AS date", "a", "b", "c", "y")


def test_all_rounds_without_evaluation_rows(spark):
    model = boosting.gbt_fit(made_up(spark), ["a", "b", "c"], "y", validation=0.0, rounds=25, rate=0.2)
    assert len(model.trees) == 25 and model.mae == 1.0


@pytest.mark.parametrize("depth", [1, 3])
def test_passes_by_level_and_by_ten_rounds_grow_the_same_trees(spark, monkeypatch, depth):
    fit = lambda: boosting.gbt_fit(made_up(spark), ["a", "b", "c"], "y", rounds=13, rate=0.3, patience=5, max_depth=depth)
    alone = fit()
    monkeypatch.setattr(histograms, "PART_ROWS", 150)  # several tasks, a shuffle of the sums
    by_level = fit()
    assert len(alone.trees) == len(by_level.trees) > 2 and alone.mae == pytest.approx(by_level.mae)
    for a, b in zip(alone.trees, by_level.trees, strict=True):
        assert a.feature.tolist() == b.feature.tolist() and a.cut.tolist() == b.cut.tolist()
        assert a.value == pytest.approx(b.value) and a.cover == pytest.approx(b.cover)


def test_patience_keeps_the_best_round(spark, monkeypatch):
    grown = []
    grow = boosting.grow
    monkeypatch.setattr(boosting, "grow", lambda *a: grown.extend(grow(*a)) or grown)
    df = made_up(spark)
    model = boosting.gbt_fit(df, ["a", "b", "c"], "y", rate=0.6, patience=3, rounds=40)
    [booster] = grown
    assert len(booster.trees) == booster.best + 3 or len(booster.trees) == 40
    assert len(model.trees) == booster.best and booster.rmse[booster.best] == min(booster.rmse[1:])
    out = boosting.gbt_predict(df, model, "p")
    assert out.selectExpr("corr(y, p) AS c").first().c > 0.9
    # a held-out error that the passes counted is the error of the model
    held = boosting.time_split(df, 0.1).where("is_validation")
    mae = boosting.gbt_predict(held, model, "p").selectExpr("avg(abs(y - p)) AS m").first().m
    assert mae == pytest.approx(model.mae, abs=1e-5)


def brute_tree(codes, g, depth, least, l2, rate):
    """A tree by trying every split, as a function of rows."""
    if depth == 0:
        return lambda x, v=rate * g.sum() / (len(g) + l2): np.full(len(x), v)
    found = (1e-9, None)
    for f in range(codes.shape[1]):
        for b in range(32):
            left = codes[:, f] <= b
            if min(left.sum(), (~left).sum()) < max(least, 1):
                continue
            gain = g[left].sum() ** 2 / (left.sum() + l2) + g[~left].sum() ** 2 / ((~left).sum() + l2) - g.sum() ** 2 / (len(g) + l2)
            if gain > found[0] + 1e-12:
                found = (gain, (f, b))
    if found[1] is None:
        return brute_tree(codes, g, 0, least, l2, rate)
    f, b = found[1]
    left = codes[:, f] <= b
    low, high = (brute_tree(codes[s], g[s], depth - 1, least, l2, rate) for s in (left, ~left))
    return lambda x: np.where(x[:, f] <= b, low(x), high(x))


def test_trees_equal_brute_force(spark):
    df = made_up(spark, 400)
    model = boosting.gbt_fit(df, ["a", "b", "c"], "y", validation=0.0, rounds=3, rate=0.5, subsample=1.0, columns=1.0)
    rows = [r for r in df.withColumn("p", boosting.F.array(*[model.scaled(c) for c in model.cols])).collect()]
    codes = model.codes(np.array([r.p for r in rows]))
    y = np.array([r.y for r in rows])
    want = np.full(len(y), y.mean())
    for tree in model.trees:
        step = brute_tree(codes, y - want, 3, 10, 5.0, 0.5)(codes)
        assert tree.predict(codes) == pytest.approx(step)
        want += step


def test_split_needs_gain_and_children():
    assert best_split(np.zeros((2, 32)), np.ones((2, 32)), 1, 5.0) is None
    g, h = np.zeros((1, 32)), np.zeros((1, 32))
    g[0, 3], g[0, 9], h[0, 3], h[0, 9] = 8.0, -8.0, 4, 4
    assert best_split(g, h, 5, 1.0) is None
    gain, f, b, left_g, left_h = best_split(g, h, 4, 1.0)
    assert (f, b, left_g, left_h) == (0, 3, 8.0, 4) and gain == pytest.approx(2 * 64 / 5)


# ---- Shapley values -----------------------------------------------------------------------------


def conditional(paths, x, known):
    """Value of the ensemble with some features known."""
    total = 0.0
    for met, value in paths:
        for f, (low, high, share) in met.items():
            value *= (low < x[f] <= high) if f in known else share
        total += value
    return total


def test_shapley_values_equal_the_sum_over_all_subsets():
    rng = np.random.default_rng(5)

    def random_tree(depth):
        if depth == 0 or rng.random() < 0.15:
            return float(rng.normal())
        return (int(rng.integers(6)), float(rng.normal()), random_tree(depth - 1), random_tree(depth - 1), float(rng.uniform(0.1, 0.9)))

    paths = [
        p for _ in range(5)
        for p in shapley.walk_paths(random_tree(6), lambda n: n if isinstance(n, tuple) else None, float)
    ]
    groups, expected = shapley.grouped(paths)
    x = rng.normal(size=(4, 6))
    got = shapley.shapley_values(groups, x)
    for row, phi in zip(x, got, strict=True):
        want = np.zeros(6)
        for j in range(6):
            others = [f for f in range(6) if f != j]
            for k in range(6):
                weight = math.factorial(k) * math.factorial(5 - k) / math.factorial(6)
                for known in combinations(others, k):
                    want[j] += weight * (conditional(paths, row, {*known, j}) - conditional(paths, row, set(known)))
        assert phi == pytest.approx(want)
        assert phi.sum() == pytest.approx(conditional(paths, row, set(range(6))) - expected)


def test_boosted_contributions_add_up(spark):
    df = made_up(spark, 200)
    model = boosting.gbt_fit(df, ["a", "b", "c"], "y", validation=0.0, rounds=8, rate=0.5)
    _, expected = model.paths()
    on = ["subject_id", "date"]
    both = boosting.gbt_shapley(df, model, on).join(boosting.gbt_predict(df, model, "p"), on).collect()
    assert len(both) == 200
    for r in both:
        assert [c.feature for c in r.contributions] == ["a", "b", "c"]
        assert sum(c.contribution for c in r.contributions) == pytest.approx(r.p - expected)


# ---- search --------------------------------------------------------------------------------------


def test_search_beats_random_draws():
    ranges = {"depth": (1, 9, "int"), "rate": (1e-4, 1.0, "log"), "share": (0.0, 1.0, "float"), "l2": (0.0, 10.0, "float")}

    def error(s):
        return abs(s["depth"] - 6) / 4 + abs(math.log10(s["rate"]) + 2) + 3 * abs(s["share"] - 0.3) + abs(s["l2"] - 7) / 3

    def searched(seed, together=5):
        guide = ParzenSearch(ranges, seed)
        for _ in range(100 // together):
            asked = [guide.ask() for _ in range(together)]
            for s in asked:
                guide.tell(s, error(s))
        assert all(low <= s[n] <= high for s, _ in guide.told for n, (low, high, _) in ranges.items())
        return [s for s, _ in guide.told], min(e for _, e in guide.told)

    best = [searched(seed)[1] for seed in range(12)]
    random = [min(map(error, drawn(100, ranges, seed))) for seed in range(12)]
    assert np.mean(best) < 0.7 * np.mean(random)
    assert searched(3) == searched(3)


def test_median_pruner():
    pruner = MedianPruner(least_trials=3, every=10)
    assert [pruner.prune(10, e) for e in (1.0, 2.0, 3.0, 2.5, 1.5)] == [False, False, False, True, False]
    assert not pruner.prune(7, 99.0) and not pruner.prune(0, 99.0) and not pruner.prune(20, 99.0)


def test_param_search_is_repeatable_and_sorted(spark, monkeypatch):
    monkeypatch.setitem(boosting.DEFAULTS, "rounds", 8)
    df = made_up(spark, 240)
    ranges = {**boosting.RANGES, "rate": (0.2, 0.6, "log"), "max_depth": (1, 2, "int")}
    found = [boosting.param_search(df, ["a", "b", "c"], "y", trials=4, in_flight=2, ranges=ranges, n_folds=2) for _ in range(2)]
    assert found[0] == found[1] and len(found[0]) == 4
    errors = [e for _, e in found[0]]
    assert errors == sorted(errors) and all(math.isfinite(e) for e in errors)
    grid = boosting.param_search(df, ["a", "b", "c"], "y", {"max_depth": [1, 2], "rate": [0.4]}, n_folds=2, prune=False)
    assert {(s["max_depth"], s["rate"]) for s, _ in grid} == {(1, 0.4), (2, 0.4)}


@pytest.mark.parametrize("driver_sums", [0, 4_000_000])
def test_level_passes_read_packed_rows_with_and_without_a_shuffle(spark, monkeypatch, driver_sums):
    """A pass reads a row a batch; sums that meet in a shuffle or in the driver give the same trees."""
    fit = lambda: boosting.gbt_fit(made_up(spark), ["a", "b", "c"], "y", rounds=18, rate=0.3, patience=18)
    alone = fit()
    staged = []

    def kept(df, name, stage=histograms.materialized):
        out = stage(df, name)
        staged.append((name, out.count()))
        return out

    monkeypatch.setattr(histograms, "PART_ROWS", 150)
    monkeypatch.setattr(histograms, "DRIVER_SUMS", driver_sums)
    monkeypatch.setattr(histograms, "materialized", kept)
    by_level = fit()
    packed = [n for name, n in staged if name == "boost-rows"]
    assert len(packed) == 2 and max(packed) <= 16  # 18 rounds write the rows twice, predictions as floats
    assert [t.value.tolist() for t in by_level.trees] == [pytest.approx(t.value.tolist(), abs=1e-5) for t in alone.trees]


def _own_way_down(tree, codes, level):
    at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
    for _ in range(level):
        at = 2 * at + 1 + (codes[rows, tree.feature[at]] > tree.cut[at])
    return at - (2**level - 1)


def test_nodes_are_found_column_by_column():
    rng = np.random.default_rng(3)
    codes = np.asfortranarray(rng.integers(0, histograms.BINS, (100_000, 21)).astype(np.uint8))
    for depth in (1, 2, 3, 4, 9):
        tree = histograms.Tree.empty(depth)
        tree.feature[:] = rng.integers(0, 21, len(tree.feature))
        tree.cut[:] = np.where(rng.random(len(tree.cut)) < 0.8, rng.integers(0, 31, len(tree.cut)), histograms.NO_SPLIT)
        for level in range(depth + 1):
            assert (tree.nodes(codes[:2000], level) == _own_way_down(tree, codes[:2000], level)).all()
    tree = histograms.Tree.empty(3)
    tree.feature[:], tree.cut[:] = np.arange(7), 15

    def seconds(run):
        taken = []
        for _ in range(5):
            began = time.process_time()
            run()
            taken.append(time.process_time() - began)
        return min(taken)

    assert seconds(lambda: tree.nodes(codes, 3)) < 0.5 * seconds(lambda: _own_way_down(tree, codes, 3))


# ---- larger tables -------------------------------------------------------------------------------


def codes_by_row(spark, n, folds=3, width=5):
    """Binned rows of ``n`` made-up days, as ``grow`` takes them."""
    learns, stops, tests = (f"X'0{k}'" for k in (histograms.TRAIN, histograms.EVALUATE, histograms.TEST))
    code = "unhex(lpad(hex(pmod(shiftright(xxhash64(id), {}), {})), 2, '0'))"
    role = f"CASE WHEN pmod(xxhash64(id, {{}}), 10) < 6 THEN {learns} WHEN pmod(xxhash64(id, {{}}), 10) < 8 THEN {stops} ELSE {tests} END"
    return spark.range(n).selectExpr(
        "xxhash64(id) AS rid", "pmod(xxhash64(id), 16) / 8.0D + pmod(shiftright(xxhash64(id), 6), 32) / 16.0D + pmod(xxhash64(id, 7), 1000) / 500.0D AS y",
        f"concat({', '.join(role.format(f, f) for f in range(folds))}) AS roles",
        f"concat({', '.join(code.format(6 * c, size) for c, size in zip(range(width), (16, 32, 7, 16, 12), strict=False))}) AS codes", "X'' AS so_far",
    )


def test_a_table_of_a_quarter_million_rows_takes_one_pass_for_ten_rounds(spark, monkeypatch):
    monkeypatch.setattr(histograms, "_pass_by_level", lambda *a: pytest.fail("a pass a level"))
    passes = []
    boosters = [histograms.Booster(f, {**boosting.DEFAULTS, "max_depth": 2, "rounds": 10}, f) for f in range(3)]
    done = histograms.grow(codes_by_row(spark, 250_000), iter(boosters), 3, 5, 10, 20, lambda active: passes.append(len(active)))
    assert [len(b.trees) for b in done] == [10] * 3 and passes == [3]


def test_lanes_continue_from_the_predictions_of_their_own_boosters(spark, monkeypatch):
    """Several stored partitions and blocks, predictions written between passes, more boosters than tasks."""
    settings = [{"max_depth": d, "rate": r, "rounds": 5} for d, r in ((1, 0.3), (2, 0.2), (3, 0.4))]
    for name, value in (("RESTAGE", 2), ("ROUNDS", 2), ("TASK_ROWS", 1_500), ("BLOCK_ROWS", 400)):
        monkeypatch.setattr(histograms, name, value)

    def grown():
        boosters = (histograms.Booster(3 * i + f, {**boosting.DEFAULTS, **s}, f) for i, s in enumerate(settings) for f in range(3))
        return sorted(histograms.grow(codes_by_row(spark, 6_000), boosters, 5, 5, 5, 20), key=lambda b: b.number)

    alone = grown()
    assert [b.rmse for b in alone] == [b.rmse for b in grown()]  # whatever order blocks arrive in
    monkeypatch.setattr(histograms, "PART_ROWS", 2_000)
    for a, b in zip(alone, grown(), strict=True):
        assert a.number == b.number and len(a.trees) == len(b.trees) == 5
        assert a.rmse == pytest.approx(b.rmse, abs=1e-5) and a.test_mae == pytest.approx(b.test_mae, abs=1e-5)


def test_columns_counted_together_have_their_own_sums():
    rng = np.random.default_rng(8)
    sizes, n = [16, 32, 1, 7, 7, 2, 32, 12, 16], 60_000
    codes = np.asfortranarray(np.stack([rng.integers(0, s, n) for s in sizes], axis=1).astype(np.uint8))
    role, rid, error = rng.integers(0, 4, n).astype(np.uint8), rng.integers(0, 1 << 62, n), rng.normal(size=n)
    tree = histograms.Tree.empty(3)
    tree.feature[:], tree.cut[:] = (0, 1, 8, 3, 4, 6, 5), (7, 15, 9, 3, histograms.NO_SPLIT, 30, 4)
    fold = histograms._Fold.of(role, rid, len(sizes))
    assert max(map(len, histograms._joined(sizes, 1, n // 16))) > 2 and set(map(len, histograms._joined(sizes, 1, 0))) == {1}
    for level in range(4):
        job = {"level": level, "columns": np.array([0, 1, 3, 4, 5, 6, 8]), "tree": tree, "round": 5, "settings": {**boosting.DEFAULTS, "subsample": 0.6}}
        rows, picked = fold.learned(job, codes)
        assert (rows == np.flatnonzero((role == histograms.TRAIN) & histograms._drawn(rid, job))).all()
        node = _own_way_down(tree, codes, level)[rows]
        found = dict(histograms._job_sums(job, fold, (rows, picked), error))
        assert sorted(k for k in found if k >= 0) == sorted(set(node.tolist())) and ({-1, -2} <= set(found)) == (level == 0)
        for at, sums in found.items():
            if at < 0:
                e = error[role == (histograms.EVALUATE if at == -1 else histograms.TEST)]
                assert sums == pytest.approx([len(e), (e * e).sum(), np.abs(e).sum()])
                continue
            g, h = sums.reshape(2, 7, histograms.BINS)
            for j, c in enumerate(job["columns"]):
                mine = rows[node == at]
                assert (h[j] == np.bincount(codes[mine, c], minlength=32)).all()
                assert g[j] == pytest.approx(np.bincount(codes[mine, c], error[mine], 32), abs=1e-9)
