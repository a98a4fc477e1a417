"""Gated detection and forecasting over all subject-days at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymo.core import SUBJECT, Keys
from kymo.functions.numeric import divergence_phase, forecast_confidence
from kymo.functions.text import describe_feature, explain_divergence, explain_text
from kymo.operators.aggregates import count_valid_days
from kymo.operators.frames import cusum
from kymo.operators.joins import latest_log_per_day
from kymo.operators.quantiles import attach
from kymo.operators.ranking import sort_by_size, top_k_drivers
from kymo.plans.boosting import BoostedModel, gbt_predict, gbt_shapley
from kymo.plans.features import DIVERGENCE_FEATURES
from kymo.plans.forest import ForestModel, shapley_attribution
from kymo.plans.linear import RidgeModel, linear_contributions, model_confidence, ridge_predict
from kymo.plans.quality import anomaly_quality_gate
from kymo.session import materialized

SENTINELS = ("no_condition_log", "no_biometric_data")
NO_DRIVERS = "ARRAY<STRUCT<feature STRING, contribution DOUBLE, direction STRING, description STRING>>"


def _signed(direction_of: Column, positive: str, negative: str, zero: str) -> Column:
    return F.when(direction_of > 0, positive).when(direction_of < 0, negative).otherwise(zero)


def anomaly_detect(
    features: DataFrame,
    model: ForestModel,
    quality: DataFrame,
    keys: Keys = SUBJECT,
    completeness_scale: float = 1.0,
    min_wear: float = 10.0,
) -> DataFrame:
    """Gate, score, adjust by confidence and explain. Days that fail the gate score 0."""
    on = [*keys, "date"]
    gated = anomaly_quality_gate(features, quality, completeness_scale, keys, min_wear)
    passed = gated.where(F.col("quality_gate") == "pass").select(*on, *model.cols)
    scored = materialized(shapley_attribution(passed, model, on, scores=True), "scored")
    out = gated.select(*on, "quality_gate", "quality_confidence").join(scored, on, "left")
    zero = lambda c: F.coalesce(F.bround(c, 4), F.lit(0.0))
    ranked = sort_by_size("contributions")
    drivers = F.transform(
        F.slice(ranked, 1, 5),
        lambda d: F.struct(
            d.feature.alias("feature"),
            F.bround(d.contribution, 4).alias("contribution"),
            _signed(-d.contribution, "anomalous", "normal", "neutral").alias("direction"),
            describe_feature(d.feature, d.value).alias("description"),
        ),
    )
    return out.select(
        *on,
        zero("anomaly_score").alias("anomaly_score"),
        zero("normalized_score").alias("normalized_score"),
        F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"),
        "quality_gate",
        F.bround("quality_confidence", 4).alias("quality_confidence"),
        zero(F.col("normalized_score") * F.col("quality_confidence")).alias("quality_adjusted_score"),
        F.coalesce(drivers, F.array().cast(NO_DRIVERS)).alias("top_drivers"),
        F.when(
            F.col("quality_gate") != "pass", F.concat(F.lit("Quality gate failed: "), F.col("quality_gate"), F.lit("."))
        ).otherwise(explain_text(ranked)).alias("explanation"),
        F.lit(model.version).alias("model_version"),
    )


def divergence_detect(
    features: DataFrame,
    logs: DataFrame,
    model: RidgeModel,
    keys: Keys = SUBJECT,
    t: str = "logged_at",
    tz_offset: float = 0,
    threshold: float = 20.0,
    days: int = 28,
) -> DataFrame:
    """Actual against predicted condition, control chart and drivers, for every date that has
    biometrics or a log. Sentinel types mark the dates that lack one of them."""
    on = [*keys, "date"]
    latest = latest_log_per_day(logs, t, "id", tz_offset, keys).select(
        *on, F.col("id").alias("condition_log_id"), F.col("overall_vas").cast("double").alias("actual_score")
    )
    days_in = features.select(*on, *DIVERGENCE_FEATURES, F.lit(True).alias("_bio"))
    both = days_in.join(latest, on, "full")
    both = linear_contributions(ridge_predict(both, model), model).drop("intercept")
    stats = model.table.select(*model.keys, "n", "r2", "residual_mean", "residual_std")
    both = attach(both, stats, model.keys)
    usable = F.col("_bio") & F.col("actual_score").isNotNull() & F.col("predicted_score").isNotNull()
    both = both.withColumn("residual", F.when(usable, F.col("actual_score") - F.col("predicted_score")))
    both = both.withColumn("phase", divergence_phase("n"))
    charted = cusum(both, "residual", F.col("residual_mean"), F.col("residual_std"), days=days, keys=keys)
    chart = F.col("phase").isin("baseline", "full") & F.col("residual").isNotNull()
    simple = (
        F.when(F.col("residual") > threshold, "feeling_better_than_expected")
        .when(F.col("residual") < -threshold, "feeling_worse_than_expected")
        .otherwise("aligned")
    )
    kind = (
        F.when(F.col("_bio").isNull(), "no_biometric_data")
        .when(F.col("residual").isNull(), "no_condition_log")
        .when(chart, F.col("divergence_type"))
        .otherwise(simple)
    )
    known = F.col("residual").isNotNull()
    out = charted.withColumns(
        {
            "divergence_type": kind,
            "cusum_positive": F.when(chart, F.col("cusum_positive")).otherwise(0.0),
            "cusum_negative": F.when(chart, F.col("cusum_negative")).otherwise(0.0),
            "cusum_alert": F.when(chart, F.col("cusum_alert")).otherwise(False),
            "confidence": F.when(known, F.bround(model_confidence(model), 4)),
            "_top": F.when(known, top_k_drivers("contributions", 5)),
        }
    )
    first = F.get("_top", F.lit(0))
    drivers = F.transform(
        "_top",
        lambda d: F.struct(
            d.feature.alias("feature"),
            d.coefficient.alias("coefficient"),
            d.value.alias("feature_value"),
            F.bround(d.contribution, 4).alias("contribution"),
            F.when(d.contribution > 0, "positive").otherwise("negative").alias("direction"),
        ),
    )
    text = (
        F.when(F.col("divergence_type") == "no_biometric_data", "No biometric data available for this date.")
        .when(F.col("divergence_type") == "no_condition_log", "No condition log recorded for this date.")
        .otherwise(explain_divergence("residual", "divergence_type", "cusum_alert", first["feature"], first["contribution"]))
    )
    shown = lambda c, d: F.when(known, F.bround(c, d)).otherwise(0.0).alias(c)
    return out.select(
        *on, "condition_log_id", shown("actual_score", 2), shown("predicted_score", 2), shown("residual", 4),
        F.bround("cusum_positive", 4).alias("cusum_positive"), F.bround("cusum_negative", 4).alias("cusum_negative"),
        "cusum_alert", "divergence_type", "phase", "confidence", drivers.alias("top_drivers"), text.alias("explanation"),
        F.lit(model.version).alias("model_version"),
    )


def valid_divergences(df: DataFrame) -> DataFrame:
    return df.where(~F.col("divergence_type").isin(*SENTINELS))


def hrv_forecast(
    features: DataFrame, model: BoostedModel, quality: DataFrame, keys: Keys = SUBJECT, second: DataFrame | None = None,
    alpha: float = 0.5,
) -> DataFrame:
    """Next-day z-score, direction and drivers; days without compliance forecast 0.

    ``second`` (keys, date, zscore, confidence) is another model's forecast to blend in.
    """
    on = [*keys, "date"]
    # Valid days are counted over the quality table first, then joined to the feature days.
    both = features.select(*on, F.lit(True).alias("_f")).join(quality.select(*on, "is_valid_day"), on, "full")
    gate = count_valid_days(both, 7, keys, "_valid").where("_f").select(*on, (F.col("_valid") >= 3).alias("compliant"))
    missing = sum((F.col(c).isNull().cast("int") for c in model.cols), F.lit(0)) / float(len(model.cols))
    scored = gbt_predict(features, model).withColumn("confidence", forecast_confidence(F.lit(model.mae), missing))
    scored = scored.select(*on, "predicted_zscore", "confidence").join(gate, on).join(gbt_shapley(features, model, on), on)
    if second is not None:
        other = second.select(*on, F.col("zscore").alias("_z"), F.col("confidence").alias("_c"))
        mix = lambda a, b: F.coalesce(alpha * F.col(a) + (1 - alpha) * F.col(b), F.col(a))
        scored = scored.join(other, on, "left").withColumns(
            {"predicted_zscore": mix("predicted_zscore", "_z"), "confidence": mix("confidence", "_c")}
        )
    ok = F.col("compliant")
    z = F.when(ok, F.bround("predicted_zscore", 4)).otherwise(0.0)
    drivers = F.transform(
        top_k_drivers("contributions", 5),
        lambda d: F.struct(
            d.feature.alias("feature"), F.bround(d.contribution, 4).alias("contribution"),
            _signed(d.contribution, "positive", "negative", "neutral").alias("direction"),
        ),
    )
    return scored.select(
        *on,
        F.date_add("date", 1).alias("target_date"),
        z.alias("predicted_zscore"),
        F.when(z >= 0, "above_baseline").otherwise("below_baseline").alias("predicted_direction"),
        F.when(ok, F.bround("confidence", 4)).otherwise(0.0).alias("confidence"),
        F.when(ok, drivers).alias("top_drivers"),
        F.lit(model.version).alias("model_version"),
    )
