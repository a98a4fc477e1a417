"""Feature preparation: imputation, winsorising, scaling, group-wise PCA."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymo.core import Keys, dbl
from kymo.operators.quantiles import attach, quantiles_wide
from kymo.session import materialized


def impute_median(df: DataFrame, cols: Sequence[str], keys: Keys = ()) -> DataFrame:
    """NULL becomes the exact median; 0 when the whole column is NULL."""
    stats = quantiles_wide(df, cols, {"_median": 0.5}, keys)
    out = attach(df, stats, keys)
    filled = {c: F.coalesce(dbl(c), F.col(f"{c}__median"), F.lit(0.0)) for c in cols}
    return out.withColumns(filled).select(*df.columns)


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(low, F.least(high, x)))


def winsorize(
    df: DataFrame, cols: Sequence[str], lo: float = 0.01, hi: float = 0.99, keys: Keys = ()
) -> DataFrame:
    stats = quantiles_wide(df, cols, {"_lo": lo, "_hi": hi}, keys)
    out = attach(df, stats, keys)
    clipped = {c: clip(dbl(c), F.col(f"{c}__lo"), F.col(f"{c}__hi")) for c in cols}
    return out.withColumns(clipped).select(*df.columns)


def standardize(
    df: DataFrame, cols: Sequence[str], center: str = "mean", keys: Keys = ()
) -> DataFrame:
    """(x - mean or median) / population deviation; a zero deviation counts as 1."""
    aggs = []
    for c in cols:
        aggs += [F.avg(dbl(c)).alias(f"{c}__mean"), F.stddev_pop(dbl(c)).alias(f"{c}__sd")]
    out = attach(df, df.groupBy(*keys).agg(*aggs), keys)
    if center == "median":
        out = attach(out, quantiles_wide(df, cols, {"_median": 0.5}, keys), keys)
    elif center != "mean":
        raise ValueError("center must be 'mean' or 'median'")
    sd = lambda c: F.when(F.col(f"{c}__sd") == 0, 1.0).otherwise(F.col(f"{c}__sd"))
    scaled = {c: (dbl(c) - F.col(f"{c}__{center}")) / sd(c) for c in cols}
    return out.withColumns(scaled).select(*df.columns)


# Feature groups, their largest number of components, and the variance kept.
PCA_GROUPS = {
    "sleep": ["sleep_duration_min", "sleep_deep_min", "sleep_rem_min", "br_full_sleep", "sleep_delta", "sleep_3d_std", "z_sleep_dur"],
    "hrv": [
        "hrv_ln_rmssd", "hrv_deep_ln_rmssd", "hrv_deep_daily_ratio", "hrv_deep_delta", "hrv_delta", "hrv_3d_std",
        "hrv_change_rate", "z_hrv",
    ],
    "heart_rate": ["resting_hr", "resting_hr_delta", "rhr_3d_std", "rhr_change_rate", "z_rhr"],
    "activity": ["steps", "calories_active", "active_zone_min", "steps_delta"],
    "other": ["spo2_avg", "skin_temp_variation", "spo2_delta", "dow_sin", "dow_cos"],
}
PCA_CAPS = {"sleep": 4, "hrv": 4, "heart_rate": 3, "activity": 3, "other": 3}
PCA_TARGET = 0.90


def components_to_keep(variances: Sequence[float], target: float) -> int:
    total = 0.0
    for i, v in enumerate(variances, start=1):
        total += v
        if total >= target:
            return i
    return max(1, len(variances))


def group_pca(
    df: DataFrame,
    groups: Mapping[str, Sequence[str]] = PCA_GROUPS,
    caps: Mapping[str, int] = PCA_CAPS,
    target: float = PCA_TARGET,
) -> DataFrame:
    """Principal components per feature group: ``{group}_pc1``..; the fewest that reach the
    target variance. Columns are centred first (Spark's transform does not); signs are free."""
    present = {g: [c for c in cols if c in df.columns] for g, cols in groups.items()}
    every = [c for cols in present.values() for c in cols]
    keep = [c for c in df.columns if c not in every]
    out = materialized(impute_median(materialized(df, "pca"), every), "pca")
    means = out.agg(*[F.avg(c).alias(f"{c}__mean") for c in every])
    out = attach(out, means).select(*keep, *[(F.col(c) - F.col(f"{c}__mean")).alias(c) for c in every])
    for g, cols in present.items():
        if not cols:
            continue
        k = min(caps.get(g, 3), len(cols))
        vec = VectorAssembler(inputCols=cols, outputCol=f"_v_{g}").transform(out)
        model = PCA(k=k, inputCol=f"_v_{g}", outputCol=f"_p_{g}").fit(vec)
        n = components_to_keep([float(x) for x in model.explainedVariance.toArray()], target)
        arr = vector_to_array(F.col(f"_p_{g}"))
        out = model.transform(vec).withColumns({f"{g}_pc{i + 1}": arr[i] for i in range(n)})
        out = out.drop(f"_v_{g}", f"_p_{g}")
    return out.drop(*every)
