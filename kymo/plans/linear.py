"""Ridge regression, one model per key, from sums that are aggregated on the cluster."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kymo.core import SUBJECT, Keys, dbl
from kymo.functions.numeric import inv_logit_vas, logit_vas, prediction_confidence
from kymo.operators.quantiles import attach, quantiles_wide
from kymo.session import checkpointed, materialized


@dataclass
class RidgeModel:
    """``table`` has one row per key: medians, means, sds, coef (arrays), intercept, fit metrics."""

    cols: list[str]
    keys: tuple[str, ...]
    logit: bool
    table: DataFrame
    version: str = ""


def _moments(cols: Sequence[str], y: str, w: Column, mark: str) -> list[Column]:
    p = len(cols)
    x = [F.col(f"_x{i}") for i in range(p)]
    target = F.col(y)
    return [
        F.sum(w).alias(f"{mark}w"),
        F.array(*[F.sum(w * a) for a in x]).alias(f"{mark}sx"),
        F.array(*[F.sum(w * x[i] * x[j]) for i in range(p) for j in range(i, p)]).alias(f"{mark}sxx"),
        F.array(*[F.sum(w * a * target) for a in x]).alias(f"{mark}sxy"),
        F.sum(w * target).alias(f"{mark}sy"),
    ]


def ridge_fit(
    df: DataFrame,
    cols: Sequence[str],
    y: str,
    alpha: float = 1.0,
    logit: bool = True,
    weight: str | None = None,
    keys: Keys = SUBJECT,
) -> RidgeModel:
    """Median imputation, standard scaling and ridge, for every key in one job.

    Each key is reduced to p(p+3)/2 sums map-side, so a key with a third of the rows shuffles
    no more than any other; only the p x p systems are solved in Python, many per batch.
    """
    cols, keys = list(cols), tuple(keys)
    p = len(cols)
    known = df.where(F.col(y).isNotNull()).select(*keys, *cols, y, *([weight] if weight else []))
    known = materialized(known, "ridge")
    med = quantiles_wide(known, cols, {"_m": 0.5}, keys)
    base = attach(known.select(*keys, *cols, F.col(y).alias("_y"), *([weight] if weight else [])), med, keys)
    base = base.withColumns(
        {
            **{f"_x{i}": F.coalesce(dbl(c) - F.col(f"{c}__m"), F.lit(0.0)) for i, c in enumerate(cols)},
            "_t": logit_vas("_y") if logit else dbl("_y"),
        }
    )
    aggs = [F.count("*").alias("n"), *_moments(cols, "_t", F.lit(1.0), "u_")]
    if weight:
        aggs += _moments(cols, "_t", dbl(weight), "w_")
    sums = base.groupBy(*keys).agg(*aggs)
    mark = "w_" if weight else "u_"

    out_schema = T.StructType(
        [
            *[sums.schema[k] for k in keys],
            T.StructField("n", T.LongType()),
            T.StructField("means", T.ArrayType(T.DoubleType())),
            T.StructField("sds", T.ArrayType(T.DoubleType())),
            T.StructField("coef", T.ArrayType(T.DoubleType())),
            T.StructField("intercept", T.DoubleType()),
        ]
    )
    upper = np.triu_indices(p)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = len(pdf)
            stack = lambda c: np.array(pdf[c].tolist(), dtype=float).reshape(m, -1)

            def second(c: str) -> np.ndarray:
                full = np.zeros((m, p, p))
                full[:, upper[0], upper[1]] = stack(c)
                return full + np.transpose(np.triu(full, 1), (0, 2, 1))

            n = pdf["u_w"].to_numpy(dtype=float)
            mean = stack("u_sx") / n[:, None]
            var = np.einsum("kii->ki", second("u_sxx")) / n[:, None] - mean**2
            sd = np.sqrt(np.maximum(var, 0.0))
            sd[sd < 1e-12 * (1.0 + np.abs(mean))] = 1.0
            w = pdf[f"{mark}w"].to_numpy(dtype=float)
            wm = stack(f"{mark}sx") / w[:, None]
            ym = pdf[f"{mark}sy"].to_numpy(dtype=float) / w
            sxx = second(f"{mark}sxx") - w[:, None, None] * wm[:, :, None] * wm[:, None, :]
            sxy = stack(f"{mark}sxy") - (w * ym)[:, None] * wm
            a = sxx / (sd[:, :, None] * sd[:, None, :]) + alpha * np.eye(p)[None]
            coef = np.linalg.solve(a, (sxy / sd)[:, :, None])[:, :, 0]
            intercept = ym - np.einsum("ki,ki->k", coef, (wm - mean) / sd)
            out = pdf[list(keys)].copy() if keys else pd.DataFrame(index=pdf.index)
            out["n"] = pdf["n"]
            out["means"], out["sds"], out["coef"] = list(mean), list(sd), list(coef)
            out["intercept"] = intercept
            yield out

    # features were centred on their medians, so that the sums keep their digits
    fitted = sums.mapInPandas(solve, out_schema)
    medians = med.select(*keys, F.array(*[F.coalesce(f"{c}__m", F.lit(0.0)) for c in cols]).alias("medians"))
    table = attach(fitted, medians, keys)
    table = checkpointed(table.withColumn("means", F.zip_with("means", "medians", lambda a, b: a + b)))
    model = RidgeModel(cols, keys, logit, table, f"ridge_{len(cols)}_{alpha:g}")

    scored = ridge_predict(known, model)
    e = dbl(y) - F.col("predicted_score")
    sst = F.var_pop(dbl(y)) * F.count("*")
    metrics = scored.groupBy(*keys).agg(
        F.when(sst > 0, 1.0 - F.try_divide(F.sum(e * e), sst)).otherwise(0.0).alias("r2"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e).alias("residual_mean"),
        F.stddev_pop(e).alias("_rs"),
    ).withColumn("residual_std", F.when(F.col("_rs") < 1e-8, 1.0).otherwise(F.col("_rs"))).drop("_rs")
    model.table = checkpointed(attach(table, metrics, keys))
    return model


def _scaled(cols: Sequence[str]) -> Column:
    filled = F.array(*[F.coalesce(dbl(c), F.get("medians", F.lit(i))) for i, c in enumerate(cols)])
    centred = F.zip_with(filled, F.col("means"), lambda x, m: x - m)
    return F.zip_with(centred, F.col("sds"), lambda x, s: x / s)


def linear_contributions(df: DataFrame, model: RidgeModel) -> DataFrame:
    """Adds ``contributions``: coefficient x scaled value per feature, in model order."""
    have = attach(df, model.table.select(*model.keys, "medians", "means", "sds", "coef", "intercept"), model.keys)
    have = have.withColumn("_scaled", _scaled(model.cols))
    parts = F.zip_with("_scaled", F.col("coef"), lambda x, b: x * b)
    names = F.array(*[F.lit(c) for c in model.cols])
    values = F.array(*[F.coalesce(dbl(c), F.lit(0.0)) for c in model.cols])
    items = F.transform(
        parts,
        lambda c, i: F.struct(
            F.get(names, i).alias("feature"), F.get(F.col("coef"), i).alias("coefficient"),
            F.get(values, i).alias("value"), c.alias("contribution"),
        ),
    )
    return have.withColumn("contributions", items).select(*df.columns, "contributions", "intercept")


def ridge_predict(df: DataFrame, model: RidgeModel) -> DataFrame:
    """Adds ``predicted_score`` (clamped to 0-100 on the logit scale) by expressions alone."""
    have = linear_contributions(df, model)
    raw = F.col("intercept") + F.aggregate("contributions", F.lit(0.0), lambda s, c: s + c.contribution)
    score = inv_logit_vas(raw) if model.logit else raw
    clamped = F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))
    return have.withColumn("predicted_score", clamped if model.logit else score).drop("contributions", "intercept")


def model_confidence(model: RidgeModel) -> Column:
    """Confidence of a scored row that carries the model's ``n`` and ``r2``."""
    missing = sum((F.col(c).isNull().cast("int") for c in model.cols), F.lit(0)) / float(len(model.cols))
    return prediction_confidence("n", "r2", 1.0 - missing)

