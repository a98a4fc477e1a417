"""Composite plans: analytic expectations and brute force."""

import datetime as dt
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kymo.operators import filters
from kymo.plans import baselines, condition, evaluation, features, forest, linear, prepare, quality, rhythm

D0 = dt.date(2024, 1, 1)
T0 = dt.datetime(2024, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def nights(spark, n=8, shift=0):
    rows, parts = [], [("deep", 7200), ("light", 10800), ("rem", 7200), ("wake", 3600)]
    for i in range(n):
        t = T0 + dt.timedelta(days=i, hours=23, minutes=shift * i)
        for stage, seconds in parts:
            rows.append((1, t, stage, seconds))
            t += dt.timedelta(seconds=seconds)
    return spark.createDataFrame(rows, "subject_id int, time timestamp, stage string, seconds int")


def test_sri_of_regular_nights_is_100(spark):
    out = {r.date: r for r in rhythm.sri(nights(spark)).collect()}
    last = out[day(8)]
    assert last.sri == pytest.approx(100.0) and last.days_used == 8
    assert out[day(3)].sri is None


def test_sri_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [
        (1, T0 + dt.timedelta(seconds=int(s)), str(rng.choice(["deep", "wake", "light"])), int(rng.integers(20, 20000)))
        for s in sorted(rng.choice(11 * 86400, 90, replace=False))
    ]
    df = spark.createDataFrame(rows, "subject_id int, time timestamp, stage string, seconds int")
    state = {}
    for _, t, stage, seconds in rows:
        e0 = math.floor((t - dt.datetime(1970, 1, 1, 12)).total_seconds() / 30)
        for e in range(e0, e0 + seconds // 30):
            state[e] = stage in ("deep", "light", "rem")
    noon = lambda e: dt.date(1970, 1, 1) + dt.timedelta(days=e // 2880 + 1)
    have = {noon(e) for e in state}
    pairs, matches = {}, {}
    for e, s in state.items():
        if e + 2880 in state:
            pairs[noon(e)] = pairs.get(noon(e), 0) + 1
            matches[noon(e)] = matches.get(noon(e), 0) + (s == state[e + 2880])
    for r in rhythm.sri(df).collect():
        window = [r.date - dt.timedelta(days=k) for k in range(1, 8)]
        n = sum(pairs.get(d, 0) for d in window)
        used = sum(d in have for d in [r.date, *window])
        assert (r.pairs, r.days_used) == (n, used)
        if used >= 7 and n:
            assert r.sri == pytest.approx(100.0 * sum(matches.get(d, 0) for d in window) / n)
        else:
            assert r.sri is None


def test_cosinor_recovers_the_curve(spark):
    rows = []
    for m in range(0, 1440, 2):
        t = T0 + dt.timedelta(hours=12, minutes=m)
        hours = t.hour + t.minute / 60
        rows.append((1, t, 70 + 12 * math.cos((hours - 16) * 2 * math.pi / 24)))
    df = spark.createDataFrame(rows, "subject_id int, time timestamp, bpm double")
    r = rhythm.cosinor(df, convention="peak").first()
    assert (r.date, r.mesor, r.amplitude, r.acrophase_hour) == (day(1), 70.0, 12.0, 16.0)
    mirrored = rhythm.cosinor(df).first().acrophase_hour
    assert mirrored == pytest.approx((12 - (16 - 12)) % 24)
    assert rhythm.cosinor(df, min_samples=721).first().mesor is None


def test_npar_of_identical_days(spark):
    rows = []
    for m in range(0, 7 * 1440, 1):
        t = T0 + dt.timedelta(hours=12, minutes=m)
        rows.append((1, t, 60 + (20 if 9 <= t.hour < 19 else 0)))
    df = spark.createDataFrame(rows, "subject_id int, time timestamp, bpm int")
    r = rhythm.npar(df).where(F.col("date") == day(7)).first()
    assert r.npar_is == 1.0 and r.m10_value == 80.0 and r.l5_value == 60.0 and r.m10_start_hour == 9.0
    assert r.npar_ra == pytest.approx(round(20 / 140, 4))


def test_nocturnal_dip(spark):
    hr = [(1, T0 + dt.timedelta(hours=12, minutes=i), 80 if i < 600 else 60) for i in range(1440)]
    stages = [(1, T0 + dt.timedelta(hours=22), "deep", 8 * 3600)]
    r = rhythm.nocturnal_dip(
        spark.createDataFrame(hr, "subject_id int, time timestamp, bpm int"),
        spark.createDataFrame(stages, "subject_id int, time timestamp, stage string, seconds int"),
    ).first()
    # 12:00-22:00 at 80, then 60; 10:00-12:00 of the next morning counts as daytime too.
    daytime = (600 * 80 + 120 * 60) / 720
    assert r.nighttime_mean_hr == 60.0 and r.daytime_mean_hr == round(daytime, 1)
    assert r.nocturnal_dip_pct == round((daytime - 60) / daytime * 100, 2)


@pytest.mark.parametrize("dip, distance", [(15.0, 0.0), (5.0, -10.0), (25.0, -10.0)])
def test_dip_distance(spark, dip, distance):
    df = spark.createDataFrame([(dip,)], "nocturnal_dip_pct double")
    assert df.select(rhythm.dip_distance().alias("x")).first()["x"] == distance


def daily(spark, n=40, **fixed):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        rows.append((1, day(i), 60 + int(rng.integers(-4, 5)), float(rng.normal(40, 4)), 400 + int(rng.integers(-40, 40)), 60 + int(rng.integers(-9, 9)), 96.0, 15.0 + float(rng.normal(0, 0.5))))
    return spark.createDataFrame(rows, "subject_id int, date date, resting_hr int, hrv_daily_rmssd double, sleep_duration_min int, sleep_deep_min int, spo2_avg double, br_full_sleep double")


def test_vri_at_the_median_is_50(spark):
    df = daily(spark)
    base = baselines.rolling_baseline(df).where(F.col("date") == day(39)).first()
    last = [(1, day(39), int(base.rhr_median), math.exp(base.ln_rmssd_median), int(base.sleep_dur_median), int(base.deep_sleep_median), 96.0, base.br_median)]
    today = df.where(F.col("date") < day(39)).unionByName(spark.createDataFrame(last, df.schema))
    r = baselines.vri(today).where(F.col("date") == day(39)).first()
    assert r.vri_score == pytest.approx(50.0, abs=1.5)
    assert r.total_valid_days == 39 and r.baseline_maturity == "warm" and r.z_sri is None
    assert r.vri_confidence == pytest.approx(min(5 / 6, 0.8 + 9 / 30 * 0.2), abs=1e-3)


def test_rolling_baseline_brute_force(spark):
    df = daily(spark)
    rows = df.collect()
    for r in baselines.rolling_baseline(df).collect():
        past = [x.resting_hr for x in rows if 1 <= (r.date - x.date).days <= 60]
        assert r.rhr_count == len(past)
        if len(past) < 7:
            assert r.rhr_median is None
        else:
            m = np.median(past)
            assert (r.rhr_median, r.rhr_mad) == (m, np.median(np.abs(np.array(past) - m)))


def test_zero_is_missing_only_for_sentinels(spark):
    df = daily(spark, 10).withColumns({"resting_hr": F.lit(0), "sleep_deep_min": F.lit(0)})
    r = baselines.rolling_baseline(df).where(F.col("date") == day(9)).first()
    assert r.rhr_count == 0 and r.deep_sleep_count == 9 and r.deep_sleep_median == 0.0


def test_rows_and_calendar_frames_differ_across_gaps(spark):
    rows = [(1, day(0), 10), (1, day(1), 20), (1, day(20), 30)]
    df = spark.createDataFrame(rows, "subject_id int, date date, steps int")
    from kymo.operators import frames

    both = frames.rolling_mean_calendar(frames.rolling_mean_rows(df, ["steps"]), ["steps"]).where(F.col("date") == day(20)).first()
    assert both.steps_mean_7r == 15.0 and both.steps_mean_7d is None


def test_condition_score_rules(spark):
    row = dict(hrv_delta=6.0, hrv_daily_rmssd=46.0, hrv_7d=40.0, sleep_duration_min=240, sleep_7d=400.0, sleep_deep_min=20, deep_sleep_7d=50.0,
               resting_hr_delta=6.0, resting_hr=66, rhr_7d=60.0, spo2_avg=92.0, spo2_7d=96.0, steps_delta=-6000.0, steps=100, steps_7d=6100.0, confidence_score=0.3)
    df = spark.createDataFrame([tuple(row.values())], list(row)).withColumn("is_valid_day", F.lit(None).cast("boolean"))
    r = condition.condition_score(df).first()
    assert r.predicted_score == 50 + 6 - 16 - 6 - 8 - 10 - 4 and r.confidence == pytest.approx(0.3)
    assert [f.feature for f in r.contributing_factors] == ["sleep_duration", "spo2", "resting_hr", "hrv", "deep_sleep", "steps"]
    bad = condition.condition_score(df.withColumn("is_valid_day", F.lit(False))).first()
    assert (bad.predicted_score, bad.confidence, bad.contributing_factors) == (50.0, pytest.approx(0.1), [])


def test_plausibility_edges(spark):
    df = spark.createDataFrame([(0, 5.0, 100.0, 5.1, None), (101, 4.9, 69.0, -5.0, 4.0)], "resting_hr int, hrv_daily_rmssd double, spo2_avg double, skin_temp_variation double, br_full_sleep double")
    a, b = [r.plausibility_flags for r in filters.plausibility_flags(df).collect()]
    assert a == {"resting_hr": "missing", "hrv_rmssd": "pass", "spo2": "pass", "skin_temp": "fail_high", "br": "missing"}
    assert b == {"resting_hr": "fail_high", "hrv_rmssd": "fail_low", "spo2": "fail_low", "skin_temp": "pass", "br": "pass"}


def test_quality_without_samples_is_invalid(spark):
    df = daily(spark, 3).withColumns({"steps": F.lit(None).cast("int"), "skin_temp_variation": F.lit(None).cast("double")})
    hr = spark.createDataFrame([(1, T0 + dt.timedelta(minutes=i)) for i in range(660)], "subject_id int, time timestamp")
    out = quality.data_quality(df, hr).orderBy("date").collect()
    assert [r.is_valid_day for r in out] == [True, False, False]
    assert [r.baseline_days for r in out] == [0, 1, 1] and out[0].completeness_pct == pytest.approx(5 / 7)


def test_warmup_range_equals_full_run(spark):
    df = daily(spark).withColumns({"hrv_deep_rmssd": F.col("hrv_daily_rmssd") * 1.1, "steps": F.lit(5000), "skin_temp_variation": F.lit(0.1)})
    plan = lambda d: features.anomaly_feature_matrix(d)
    part = features.in_range(plan, df, day(20), day(25), warmup=7).orderBy("date").collect()
    full = plan(df).where(F.col("date").between(day(20), day(25))).orderBy("date").collect()
    assert part == full and len(part) == 6


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(50, 5)) * [1, 10, 1000, 0.1, 5] + [0, 60, 8000, 95, 1]
    z = (x - x.mean(0)) / x.std(0)
    y = np.clip(50 + 10 * z[:, 0] - 6 * z[:, 1] + 4 * rng.normal(size=50), 1, 99)
    cols = [f"f{i}" for i in range(5)]
    df = spark.createDataFrame([(1, *map(float, row), float(t)) for row, t in zip(x, y)], ["subject_id", *cols, "y"])
    row = linear.ridge_fit(df, cols, "y").table.first()
    t = np.log(y / 100 / (1 - y / 100))
    coef = np.linalg.solve(z.T @ z + np.eye(5), z.T @ (t - t.mean()))
    assert np.allclose(row.coef, coef, atol=1e-8) and row.intercept == pytest.approx(t.mean())
    pred = 100 / (1 + np.exp(-(t.mean() + z @ coef)))
    assert row.mae == pytest.approx(np.mean(np.abs(y - pred)))
    assert row.r2 == pytest.approx(1 - np.sum((y - pred) ** 2) / np.sum((y - y.mean()) ** 2))


def test_isolation_forest_finds_the_outliers(spark):
    rng = np.random.RandomState(42)
    x = rng.randn(102, 5)
    x[100:] *= 10
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    cols = [f"f{i}" for i in range(5)]
    df = spark.createDataFrame(rows, ["id", *cols])
    model = forest.isolation_forest_train(df, cols, trees=50, psi=64, row_id=["id"])
    out = {r.id: r for r in forest.isolation_forest_score(df, model, ["id"]).collect()}
    worst = sorted(out, key=lambda i: out[i].anomaly_score)[:4]
    assert {100, 101} <= set(worst)
    assert all(0.0 <= r.normalized_score <= 1.0 for r in out.values())
    parts = forest.ablation_attribution(df, model, ["id"]).where("id = 100").first().contributions
    assert [p.feature for p in parts] == cols and min(p.contribution for p in parts) < 0
    # depths recomputed from the stored trees, and Shapley values that add up to them
    x = {r.id: np.array([r[c] for c in cols]) for r in df.collect()}
    _, expected = model.paths()
    for r in forest.shapley_attribution(df, model, ["id"], scores=True).where("id % 20 = 0").collect():
        row = np.clip(x[r.id], [model.low[c] for c in cols], [model.high[c] for c in cols])
        depths = []
        for t in range(50):
            node = 0
            while (f := model.arrays["feature"][t, node]) >= 0:
                node = model.arrays["left" if row[f] < model.arrays["split"][t, node] else "right"][t, node]
            depths.append(model.arrays["path"][t, node])
        assert r.anomaly_score == pytest.approx(-(2 ** (-np.mean(depths) / forest.average_path(np.array(64)))) - model.offset)
        assert sum(c.contribution for c in r.contributions) == pytest.approx(np.mean(depths) - expected)
    again = forest.isolation_forest_train(df, cols, trees=50, psi=64, row_id=["id"])
    assert np.array_equal(again.arrays["split"], model.arrays["split"])


def test_average_path():
    assert forest.average_path(np.array([1, 2])).tolist() == [0.0, 1.0]
    assert forest.average_path(np.array(256)) == pytest.approx(10.244, abs=1e-3)


def test_impute_all_null_column(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (4.0, None)], "a double, b double")
    got = sorted((r.a, r.b) for r in prepare.impute_median(df, ["a", "b"]).collect())
    assert got == [(1.0, 0.0), (2.5, 0.0), (4.0, 0.0)]


def test_components_to_keep():
    assert prepare.components_to_keep([0.95, 0.05], 0.9) == 1
    assert prepare.components_to_keep([0.5, 0.3, 0.15], 0.9) == 3
    assert prepare.components_to_keep([0.5, 0.3], 0.9) == 2


def test_blend_needs_rows_and_takes_the_first_best(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0)] * 6, "a double, b double, y double")
    assert evaluation.blend_search(df, "a", "b", "y").first().alpha == 0.3
    assert evaluation.blend_search(df.limit(4), "a", "b", "y").first().alpha == 0.5


def test_pot_threshold_falls_back(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)], "score double")
    r = evaluation.pot_threshold(df).first()
    assert r.n_tail == 1 and r.threshold == pytest.approx(np.quantile(np.arange(20), 0.02))


def test_cosinor_of_samples_within_minutes_and_without_values(spark):
    """Samples of a curve fix it however close they are; those without a value say nothing."""
    rows = []
    for i, m in enumerate((0, 2, 5, 9, 14)):
        t = T0 + dt.timedelta(hours=14, minutes=m)
        hours = t.hour + t.minute / 60
        rows.append((1, t, 70 + 12 * math.cos((hours - 16) * 2 * math.pi / 24)))
    rows += [(1, T0 + dt.timedelta(hours=20, minutes=m), None) for m in range(3)]
    df = spark.createDataFrame(rows, "subject_id int, time timestamp, bpm double").coalesce(1)
    r = rhythm.cosinor(df, min_samples=5, convention="peak", digits=None).first()
    assert r.n_samples == 5
    assert (r.mesor, r.amplitude, r.acrophase_hour) == pytest.approx((70.0, 12.0, 16.0), abs=1e-4)


def made_up_forest(trees=12, psi=64, features=5):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, features))
    grown = [forest.grow_tree(x[rng.choice(len(x), psi, replace=False)], rng, 6) for _ in range(trees)]
    width = max(map(len, grown))
    arrays = {"height": 6}
    names = (("feature", np.int32, -1), ("split", float, 0.0), ("left", np.int32, 0), ("right", np.int32, 0), ("path", float, 0.0), ("cover", np.int32, 0))
    for i, (name, kind, empty) in enumerate(names):
        arrays[name] = np.full((trees, width), empty, dtype=kind)
        for t, nodes in enumerate(grown):
            arrays[name][t, : len(nodes)] = [n[i] for n in nodes]
    cols = [f"c{i}" for i in range(features)]
    return forest.ForestModel(cols, dict.fromkeys(cols, 0.0), {}, {}, psi, arrays), x


def test_ablation_walks_only_trees_in_which_a_row_meets_the_feature(monkeypatch):
    model, x = made_up_forest()
    x[::7, 2] = 0.0
    want = np.zeros_like(x)
    for j in range(x.shape[1]):
        y = x.copy()
        y[:, j] = 0.0
        want[:, j] = model.decision(x) - model.decision(y)
    walked, leaves = [], forest.ForestModel.leaves
    monkeypatch.setattr(forest.ForestModel, "leaves", lambda m, flat, x, rows, *more: (walked.append(len(rows)), leaves(m, flat, x, rows, *more))[1])
    got = forest._ablations(model, None, x, model.decision(x))
    assert np.array_equal(got, want) and np.abs(got).max() > 0
    every = len(x) * len(model.arrays["feature"])
    assert sum(walked) < every * (2 + 0.85 * x.shape[1])


def test_shapley_values_look_up_sets_of_met_conditions(monkeypatch):
    from kymo.plans import shapley

    model, x = made_up_forest()
    groups, expected = model.paths()
    got = shapley.shapley_values(groups, x)
    assert all(g.table is not None and len(g.table) == len(g.feature) * 2 ** g.feature.shape[1] for g in groups)
    assert got.sum(axis=1) + expected == pytest.approx(model.depth(x))
    monkeypatch.setattr(shapley, "TABLE", 0)
    assert shapley.shapley_values(groups, x) == pytest.approx(got, abs=1e-12)


def test_week_sums_by_brute_force_and_by_any_batch(monkeypatch):
    rng = np.random.default_rng(3)
    weeks, days = [], list(range(50, 90))
    for day in days:
        have = [d for d in range(day - 6, day + 1) if d == day or rng.random() < 0.6]
        weeks.append([{"d": d, "x": [float(v) if rng.random() < 0.8 else None for v in rng.normal(60, 9, 24)]} for d in have])
    weeks.append([{"d": None, "x": [1.0] * 24}, {"d": None, "x": [2.0] * 24}])
    held = pa.array([[], *weeks], pa.list_(pa.struct({"d": pa.int32(), "x": pa.list_(pa.float64())})))[1:]  # a slice
    call = rhythm.week_moments(7, 15, 3).func
    got = call(held, pa.array([*days, None], pa.int32())).to_pylist()
    monkeypatch.setattr(rhythm, "_CHUNK", 500)
    assert call(held, pa.array([*days, None], pa.int32())).to_pylist() == got
    some = 0
    for day, week, out in zip(days, weeks, got):
        x = [next((w["x"] for w in week if w["d"] == d), [None] * 24) for d in range(day - 6, day + 1)]
        hours = [[r[h] for r in x if r[h] is not None] for h in range(24)]
        if sum(sum(v is not None for v in r) >= 15 for r in x) < 3 or not all(hours):
            assert out is None or out["all"] is None
            continue
        some, mean = some + 1, [sum(v) / len(v) for v in hours]
        full = [mean[h] if v is None else v for r in x for h, v in enumerate(r)]
        avg = sum(full) / 168
        assert out["between"] == pytest.approx(sum((m - avg) ** 2 for m in mean))
        assert out["all"] == pytest.approx(sum((v - avg) ** 2 for v in full))
        assert out["steps"] == pytest.approx(sum((b - a) ** 2 for a, b in zip(full, full[1:])))
        assert out["last"] == pytest.approx(full[-24:])
    assert some > 10 and got[-1]["all"] is None


def test_npar_takes_samples_without_a_time(spark):
    rows = [(1, None, 60), (1, None, 61), *[(1, T0 + dt.timedelta(hours=h), 60 + h % 24) for h in range(24 * 8)]]
    out = rhythm.npar(spark.createDataFrame(rows, "subject_id int, time timestamp, bpm int"), min_per_cell=1)
    got = {r.date: r.npar_is for r in out.collect()}
    assert got[None] is None and got[day(7)] == pytest.approx(1.0)
