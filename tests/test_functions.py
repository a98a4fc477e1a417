"""Column builders on literal rows."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kymo.functions import circular, clock, numeric, text, vocab


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "value, median, mad, floor, expected",
    [(70.0, 60.0, 5.0, 0.0, 1.349), (70.0, 60.0, 0.0, 0.0, 0.0), (95.0, 96.0, 0.5, 1.0, -0.6745), (None, 60.0, 5.0, 0.0, None)],
)
def test_robust_z(spark, value, median, mad, floor, expected):
    z = one(spark, numeric.robust_z(F.lit(value).cast("double"), F.lit(median), F.lit(mad), floor))
    assert z == expected if expected is None else z == pytest.approx(expected)


@pytest.mark.parametrize("vas, legacy", [(0, 1), (19, 1), (20, 2), (79, 4), (80, 5), (100, 5)])
def test_vas_to_legacy(spark, vas, legacy):
    assert one(spark, numeric.vas_to_legacy(F.lit(vas))) == legacy


@pytest.mark.parametrize("n, factor", [(0, 0.0), (7, 0.25), (14, 0.5), (30, 0.8), (60, 1.0), (300, 1.0)])
def test_baseline_maturity(spark, n, factor):
    assert one(spark, numeric.baseline_maturity(F.lit(n))) == pytest.approx(factor)


@pytest.mark.parametrize(
    "table, x, label", [("vas_label", 10, "Very Poor"), ("vas_label", 11, "Poor"), ("score", 70, "good"), ("score", 69, "fair"), ("onset_latency", 15, "good")]
)
def test_score_band_edges(spark, table, x, label):
    assert one(spark, numeric.score_band(F.lit(x), table)) == label


def test_dip_band_edges(spark):
    got = [one(spark, numeric.dip_band(F.lit(x))) for x in (9.9, 10.0, 20.0, 20.1)]
    assert got == ["non-dipper", "normal", "normal", "extreme dipper"]


@pytest.mark.parametrize("minutes, mean", [([170, 180, 190], 180.0), ([1410, 30], 0.0), ([1430, 1430], 1430.0)])
def test_circular_mean(spark, minutes, mean):
    df = spark.createDataFrame([(float(m),) for m in minutes], "m double")
    got = df.agg(circular.circular_mean("m").alias("x")).first()["x"]
    assert min(abs(got - mean), 1440 - abs(got - mean)) == pytest.approx(0.0, abs=1e-6)


def test_circular_std_edges(spark):
    df = spark.createDataFrame([(100.0,)], "m double")
    assert df.agg(circular.circular_std("m").alias("x")).first()["x"] == 0.0
    same = spark.createDataFrame([(100.0,), (100.0,)], "m double")
    assert same.agg(circular.circular_std("m").alias("x")).first()["x"] == pytest.approx(0.0, abs=1e-4)


def test_sleep_midpoint_crosses_midnight(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, clock.sleep_midpoint(t("2024-01-01 23:00:00"), t("2024-01-02 07:00:00"))) == pytest.approx(180.0)
    assert one(spark, clock.sleep_midpoint(t("2024-01-02 01:00:00"), t("2024-01-02 07:00:00"))) == pytest.approx(240.0)


@pytest.mark.parametrize("t, day", [("2024-01-14 11:59:59", dt.date(2024, 1, 14)), ("2024-01-14 12:00:00", dt.date(2024, 1, 15)), ("2024-01-15 03:00:00", dt.date(2024, 1, 15))])
def test_noon_day(spark, t, day):
    assert one(spark, clock.noon_day(F.lit(t).cast("timestamp"))) == day


def test_local_date_from_millis_before_epoch(spark):
    assert one(spark, clock.local_date_from_millis(F.lit(-1), 0)) == dt.date(1969, 12, 31)
    assert one(spark, clock.local_date_from_millis(F.lit(-1), 9)) == dt.date(1970, 1, 1)


@pytest.mark.parametrize("birth, on, age", [("1990-05-10", "2024-05-09", 33), ("1990-05-10", "2024-05-10", 34)])
def test_age_at(spark, birth, on, age):
    assert one(spark, clock.age_at(F.lit(birth).cast("date"), F.lit(on).cast("date"))) == age


@pytest.mark.parametrize("text_, mid", [("42.5-46.4", 44.45), ("40", 40.0), ("", None), ("high", None), ("40-high", None)])
def test_parse_range_midpoint(spark, text_, mid):
    got = one(spark, vocab.parse_range_midpoint(F.lit(text_)))
    assert got == mid if mid is None else got == pytest.approx(mid)


@pytest.mark.parametrize(
    "value, fixed, legacy", [("X.AsleepDeep", "deep", "light"), ("X.AsleepREM", "rem", "light"), ("X.AsleepCore", "light", "light"), ("X.Awake", "wake", "wake"), ("X.InBed", "inbed", "inbed"), ("?", "unknown", "unknown")]
)
def test_map_stage_text(spark, value, fixed, legacy):
    assert one(spark, vocab.map_stage_text(F.lit(value))) == fixed
    assert one(spark, vocab.map_stage_text(F.lit(value), legacy=True)) == legacy


def test_exercise_table(spark):
    assert len(vocab.EXERCISES) == 46
    df = spark.createDataFrame([(49,), (0,), (57,)], "code int")
    got = {r["code"]: r["activity_name"] for r in vocab.map_exercise_code(df).collect()}
    assert got == {49: "Running", 0: "Other", 57: "Skiing"}


def test_clean_generated_text(spark):
    body = "おはようございます。😀\n\n\n\n```code\nx```" + "良い一日です。" * 300 + "医師に相談"
    df = spark.createDataFrame([(body,), ("short",)], "text string")
    long, short = text.clean_generated_text(df).collect()
    assert len(long["clean_text"]) <= 1500 and long["clean_text"].endswith("。")
    assert "```" not in long["clean_text"] and "😀" not in long["clean_text"] and "\n\n\n" not in long["clean_text"]
    assert long["warnings"][0] == "medical_term_replaced: 医師に相談" and long["warnings"][1].startswith("truncated: ")
    assert short["warnings"] == ["short_output: 5 chars", "missing_greeting"]


def test_logit_round_trip(spark):
    for vas in (0.5, 20.0, 50.0, 99.5):
        assert one(spark, numeric.inv_logit_vas(numeric.logit_vas(F.lit(vas)))) == pytest.approx(vas)
    assert one(spark, numeric.logit_vas(F.lit(0.0))) == pytest.approx(math.log(0.005 / 0.995))


def test_humanize_feature(spark):
    assert one(spark, vocab.humanize_feature(F.lit("spo2_avg"))) == "SpO2"
    assert one(spark, vocab.humanize_feature(F.lit("night_sleep"))) == "Night Sleep"


def test_fixed_rounds_the_binary_value(spark):
    rng = np.random.default_rng(3)
    values = [99.55, 86.35, 0.25, 0.75, 0.05, 0.0, -0.04, -2.25, -0.35, 1e6 + 0.05, 12345678.95, *np.round(rng.uniform(-300, 300, 4000), 2), *rng.uniform(-3, 3, 500)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    rows = df.select("v", text.fixed("v", 1).alias("one"), text.fixed("v", 2).alias("two"), text.fixed("v", 2, sign=True).alias("plus")).collect()
    for r in rows:
        assert (r.one, r.two, r.plus) == (f"{r.v:.1f}", f"{r.v:.2f}", f"{r.v:+.2f}")
    assert df.limit(1).select(text.fixed(F.lit(None).cast("double"), 1).alias("x")).first().x is None


@pytest.mark.parametrize("minutes", [[1352.35, 87.65], [31.4, 1408.6, 492.66, 947.3399999999999], [471.51, 968.49, 59.18, 1380.82], [178.13, 1261.87, 334.43, 1105.57]])
def test_circular_mean_of_midnight_lies_in_the_day(spark, minutes):
    one_task = spark.createDataFrame([(m,) for m in minutes], "m double").coalesce(1)
    got = one_task.agg(circular.circular_mean("m").alias("x")).first()["x"]
    assert 0.0 <= got < 1e-6
