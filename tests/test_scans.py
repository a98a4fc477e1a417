"""Scans, intervals and quantiles against brute force, with one key holding most rows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kymo.operators import frames, intervals as iv, quantiles, ranking, reconcile, scan

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def stages(spark):
    """Two thirds of the rows belong to subject 1; times are unique per subject."""
    rng = random.Random(7)
    rows = []
    for subject, n in ((1, 200), (2, 60), (3, 40)):
        for i, s in enumerate(sorted(rng.sample(range(0, 5 * 86400, 60), n))):
            rows.append((subject, at(s), rng.choice(["deep", "light", "rem", "wake"]), rng.randrange(30, 9000), i))
    return spark.createDataFrame(rows, "subject_id int, time timestamp, stage string, seconds int, event_id int").cache()


def test_prefix_scan_equals_plain_window(stages):
    w = Window.partitionBy("subject_id").orderBy("time")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    got = scan.prefix_scan(
        stages,
        {"s": ("sum", F.col("seconds")), "m": ("max", F.col("seconds")), "b": ("max_before", F.col("seconds")), "p": ("prev", F.col("event_id"))},
        ["subject_id"], "time", chunk_us=3_600_000_000,
    )
    want = stages.select(
        *stages.columns, F.sum("seconds").over(up).alias("s"), F.max("seconds").over(up).alias("m"),
        F.max("seconds").over(before).alias("b"), F.lag("event_id").over(w).alias("p"),
    )
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_flag_inside_brute_force(spark, stages):
    rng = random.Random(3)
    points = spark.createDataFrame(
        [(s, at(rng.randrange(0, 5 * 86400)), i) for i in range(300) for s in (1, 2)], "subject_id int, time timestamp, pid int"
    )
    spans = stages.select("subject_id", F.col("time").alias("start"), F.expr("timestampadd(SECOND, seconds, time)").alias("end"))
    table = [(r.subject_id, r.start, r.end) for r in spans.collect()]
    for closed in (False, True):
        got = {(r.subject_id, r.pid): r.inside for r in iv.flag_inside(points, spans, closed_end=closed).collect()}
        for r in points.collect():
            want = any(k == r.subject_id and a <= r.time and (r.time <= b if closed else r.time < b) for k, a, b in table)
            assert got[(r.subject_id, r.pid)] == want


def test_closed_and_half_open_ends(spark):
    spans = spark.createDataFrame([(1, at(0), at(60))], "subject_id int, start timestamp, end timestamp")
    points = spark.createDataFrame([(1, at(0)), (1, at(59)), (1, at(60)), (1, at(61))], "subject_id int, time timestamp")
    half = [r.inside for r in iv.flag_inside(points, spans).orderBy("time").collect()]
    closed = [r.inside for r in iv.flag_inside(points, spans, closed_end=True).orderBy("time").collect()]
    assert half == [True, True, False, False] and closed == [True, True, True, False]


def test_gap_sessionize_exact_gap_merges(spark):
    rows = [(1, at(0), at(600)), (1, at(2400), at(3000)), (1, at(4801), at(5000)), (1, at(4900), at(4950)), (1, at(6800), at(6900))]
    df = spark.createDataFrame(rows, "subject_id int, start timestamp, end timestamp")
    got = [r.session_no for r in iv.gap_sessionize(df).orderBy("start").collect()]
    # 1800 s after the end merges; 1801 s opens; the last row looks at the row before, not at the latest end.
    assert got == [1, 1, 2, 2, 3]


def test_overlap_chain_dedup_brute_force(stages):
    got = {(r.subject_id, r.event_id) for r in iv.overlap_chain_dedup(stages, keys=["subject_id"]).collect()}
    want, reach = set(), {}
    for r in sorted(stages.collect(), key=lambda r: (r.subject_id, r.time)):
        if r.subject_id not in reach or r.time >= reach[r.subject_id]:
            want.add((r.subject_id, r.event_id))
            reach[r.subject_id] = r.time + dt.timedelta(seconds=r.seconds)
    assert got == want


def greedy(rows):
    kept, reach = set(), None
    for i, (t, seconds) in sorted(enumerate(rows), key=lambda r: (r[1][0], r[0])):
        if reach is None or t >= reach:
            kept.add(i)
            reach = t + seconds
    return kept


def test_overlap_chain_of_one_long_island(spark):
    """One island of 3,000 rows, with ties: a chain of about a thousand links."""
    rng = random.Random(8)
    rows = [(rng.randrange(0, 30_000) // 10 * 10, rng.choice([0, 10, 25, 30, 40])) for _ in range(2999)] + [(0, 40_000)]
    rows[-1] = (1, 20)
    df = spark.createDataFrame([(1, at(t), s, i) for i, (t, s) in enumerate(rows)], "subject_id int, time timestamp, seconds int, event_id int")
    got = {r.event_id for r in iv.overlap_chain_dedup(df, keys=["subject_id"], tie=["event_id"]).collect()}
    assert got == greedy(rows) and len(got) > 700


def test_chain_trace_of_a_long_run(spark):
    rng = random.Random(9)
    t, rows = 0, []
    for _ in range(300):
        step = rng.choice([20, 30])
        rows += [(t, step), (t + 5, 35)] + ([(t, 50)] if rng.random() < 0.3 else [])
        t += step
    reach, want = {0}, []
    for i, (a, s) in sorted(enumerate(rows), key=lambda r: (r[1][0], r[0])):
        if a in reach:
            want.append(i)
            reach.add(a + s)
    df = spark.createDataFrame([(7, at(a), s, i) for i, (a, s) in enumerate(rows)], "log_id int, time timestamp, seconds int, event_id int")
    assert sorted(r.event_id for r in iv.chain_trace(df, keys=[]).collect()) == sorted(want)


def test_gap_sessionize_with_equal_starts(spark):
    """Equal starts are ordered by their end in both scans: the row before the last is the longer."""
    rows = [(1, at(0), at(4000)), (1, at(0), at(10)), (1, at(5000), at(5100))]
    df = spark.createDataFrame(rows, "subject_id int, start timestamp, end timestamp").repartition(3)
    got = sorted((r.start, r.end, r.session_no) for r in iv.gap_sessionize(df).collect())
    assert [n for _, _, n in got] == [1, 1, 1]


def test_chain_trace(spark):
    rows = [(1, 9, at(0), 60), (1, 9, at(30), 600), (1, 9, at(60), 60), (1, 9, at(120), 30), (1, 9, at(160), 60), (1, 8, at(0), 60), (1, 8, at(61), 60)]
    df = spark.createDataFrame(rows, "subject_id int, log_id int, time timestamp, seconds int")
    got = sorted((r.log_id, int((r.time - T0).total_seconds())) for r in iv.chain_trace(df).collect())
    assert got == [(8, 0), (9, 0), (9, 60), (9, 120)]


def test_proximity_anti_join_brute_force(spark):
    rng = random.Random(11)
    make = lambda n: [(rng.choice([1, 1, 2]), at(rng.randrange(0, 40000)), i) for i in range(n)]
    a, b = make(200), make(60)
    schema = "subject_id int, time timestamp, pid int"
    got = {r.pid for r in iv.proximity_anti_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()}
    want = {p for k, t, p in a if not any(k == k2 and abs((t - t2).total_seconds()) <= 300 for k2, t2, _ in b)}
    assert got == want


def test_running_cusum_continues(spark):
    rng = np.random.default_rng(5)
    rows = [(s, at(int(i * 7000)), i, float(x)) for s in (1, 2) for i, x in enumerate(rng.normal(0.2, 1.5, 80))]
    df = spark.createDataFrame(rows, "subject_id int, time timestamp, event_id int, r double")
    want = {}
    for s, _, i, x in rows:
        up, down = want.get((s, i - 1), (0.0, 0.0))
        want[(s, i)] = (max(0.0, up + x - 0.5), max(0.0, down - x - 0.5))
    first = scan.running_cusum(df.where("event_id < 40"), "r", 0.0, 1.0, ["subject_id"], "time", ["event_id"])
    start = first.where("event_id = 39").select("subject_id", "cusum_positive", "cusum_negative")
    rest = scan.running_cusum(df.where("event_id >= 40"), "r", 0.0, 1.0, ["subject_id"], "time", ["event_id"], start=start)
    for r in first.unionByName(rest).collect():
        assert (r.cusum_positive, r.cusum_negative) == pytest.approx(want[(r.subject_id, r.event_id)], abs=1e-9)


def test_daily_cusum_brute_force(spark):
    rng = np.random.default_rng(2)
    days = [i for i in range(60) if i % 7 != 3]
    rows = [(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(x)) for i, x in zip(days, rng.normal(0.3, 1.0, len(days)))]
    df = spark.createDataFrame(rows, "subject_id int, date date, residual double")
    for r in frames.cusum(df).collect():
        up = down = 0.0
        for _, d, x in rows:
            if 0 <= (r.date - d).days <= 28:
                up, down = max(0.0, up + x - 0.5), max(0.0, down - x - 0.5)
        assert (r.cusum_positive, r.cusum_negative) == pytest.approx((up, down))
        assert r.cusum_alert == (up > 4 or down > 4)


def test_exact_quantiles_small_and_bracketed(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=4000), np.zeros(2500), rng.exponential(size=1501)])
    df = spark.createDataFrame([(1, float(v)) for v in x] + [(2, 5.0), (2, 7.0), (2, None)], "k int, x double").repartition(4)
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    for small in (20_000, 100):  # the second limit forces the bracketed path
        monkeypatch.setattr(quantiles, "SMALL", small)
        got = {(r.k, r.p): r.value for r in quantiles.exact_quantiles(df, ["x"], probs, ["k"]).collect()}
        for p in probs:
            assert got[(1, p)] == pytest.approx(np.quantile(x, p)), (small, p)
        assert got[(2, 0.5)] == 6.0


def test_sliding_circular_window_wraps(spark):
    profile = [0.0] * 24
    profile[23] = profile[0] = profile[1] = 100.0
    df = spark.createDataFrame([(1, h, v) for h, v in enumerate(profile)], "subject_id int, hour int, value double")
    r = frames.sliding_circular_window(df, width=5).first()
    assert (r.max_mean, r.max_start) == (60.0, 21) and r.min_mean == 0.0
    ramp = spark.createDataFrame([(1, h, float(h)) for h in range(24)], "subject_id int, hour int, value double")
    assert frames.sliding_circular_window(ramp, width=5).first().min_mean == 2.0


@pytest.mark.parametrize(
    "values, expected", [({3: 50, 5: 70}, 50), ({3: 500, 5: 70}, 70), ({3: 500, 5: 700}, 500), ({3: 500}, 500), ({5: 700}, 700), ({9: 1}, None)]
)
def test_plausible_pick_cases(spark, values, expected):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1), s, float(v)) for s, v in values.items()], "subject_id int, date date, source_id int, value double")
    got = reconcile.plausible_pick(df, [3, 5], lambda v: v <= 100).collect()
    assert (got[0].value if got else None) == expected


def test_top_k_keeps_order_of_equals(spark):
    df = spark.sql("SELECT array(named_struct('f','a','contribution',1.0D), named_struct('f','b','contribution',-2.0D), named_struct('f','c','contribution',2.0D), named_struct('f','d','contribution',0.5D)) AS xs")
    got = df.select(F.transform(ranking.top_k_drivers("xs", 3), lambda d: d.f).alias("n")).first()["n"]
    assert got == ["b", "c", "a"]


def test_paged_list_limits(spark):
    df = spark.createDataFrame([(1, i, at(i)) for i in range(150)], "subject_id int, id int, logged_at timestamp")
    page = ranking.paged_list(df, "nonsense", "desc", 500, 10).collect()
    assert len(page) == 100 and {r.total for r in page} == {150} and max(r.id for r in page) == 139


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_raw_windows_are_split_by_time_chunk(stages, monkeypatch):
    """No window over raw rows may be partitioned by the subject alone."""
    staged = []  # the steps of the chain are written out, so their plans count
    monkeypatch.setattr(iv, "materialized", lambda df, name, write=iv.materialized: staged.append(df) or write(df, name))
    iv.overlap_chain_dedup(stages, keys=["subject_id"])
    assert any("Window [" in plan_of(df) for df in staged)
    for df in staged:
        assert "collect_list" not in plan_of(df)
    spans = stages.select("subject_id", F.col("time").alias("start"), F.expr("timestampadd(SECOND, seconds, time)").alias("end"))
    for df in (iv.flag_inside(stages.select("subject_id", "time"), spans), iv.gap_sessionize(spans), *staged):
        windows = [line for line in plan_of(df).splitlines() if "Window [" in line]
        assert windows or df in staged
        for line in windows:
            over_summary = "_s0#" in line  # one row per chunk
            assert over_summary or "_chunk" in line.rsplit("], [", 2)[-2], line


def test_no_pair_joins(stages):
    spans = stages.select("subject_id", F.col("time").alias("start"), F.expr("timestampadd(SECOND, seconds, time)").alias("end"))
    for df in (iv.flag_inside(stages.select("subject_id", "time"), spans), iv.proximity_anti_join(stages, stages.where("event_id < 9"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_delta_vs_mean_of_rows_ignores_a_row_without_date(spark):
    rows = [(1, dt.date(2024, 1, 1), 50.0), (1, dt.date(2024, 1, 2), 60.0), (1, None, 9.0)]
    df = spark.createDataFrame(rows, "subject_id int, date date, x double")
    got = {r.date: r.x_delta for r in frames.delta_vs_mean(df, "x", frame="rows").collect()}
    assert got == {dt.date(2024, 1, 1): None, dt.date(2024, 1, 2): 10.0, None: 9.0 - 55.0}


def test_cusum_alert_needs_more_than_the_rounding_of_its_sums(spark):
    """Forty steps of 0.1 add up to the limit of 4, which is no alert in any order of adding."""
    rows = [(1, at(i * 60), i, 0.6) for i in range(41)]
    df = spark.createDataFrame(rows, "subject_id int, time timestamp, event_id int, r double")
    out = scan.running_cusum(df, "r", 0.0, 1.0, ["subject_id"], "time", ["event_id"])
    assert [r.event_id for r in out.where("cusum_alert").collect()] == [40]
