"""Walk-forward evaluation, metrics, blending and thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kymo.core import SUBJECT, ColumnOrName, Keys, day_number, dbl
from kymo.operators.prefix_ranks import prefix_medians
from kymo.operators.quantiles import attach, quantiles_wide
from kymo.session import materialized


def walk_forward_folds(df: DataFrame, min_train: int = 90, gap: int = 1, keys: Keys = SUBJECT) -> DataFrame:
    """One row per fold: its test day and the bounds of its expanding training window.

    Folds are described, not materialised: copying the training rows of every fold would be
    quadratic. ``fold_normalise`` reads them through an expanding frame instead.
    """
    w = Window.partitionBy(*keys).orderBy(day_number("date"))
    at = F.row_number().over(w) - 1
    out = df.select(
        *keys,
        F.col("date").alias("test_date"),
        at.cast("long").alias("_i"),
        F.lag("date", gap + 1).over(w).alias("train_end"),
        F.min("date").over(Window.partitionBy(*keys)).alias("train_start"),
    )
    return out.where(F.col("_i") >= min_train + gap).select(
        *keys, (F.col("_i") - (min_train + gap)).alias("fold_idx"), "train_start", "train_end", "test_date",
        (F.col("_i") - gap).alias("n_train"),
    )


def fold_normalise(
    df: DataFrame, cols: Sequence[str], min_train: int = 90, gap: int = 1, keys: Keys = SUBJECT
) -> DataFrame:
    """Each test row scaled by the median and deviation of its own fold's training rows.

    Medians of the growing training windows come from ``prefix_medians``: a series of n days costs
    n log n, where a percentile over a growing frame costs n squared. A column without any training
    value is NULL.
    """
    cols = list(cols)
    w = Window.partitionBy(*keys).orderBy(day_number("date"))
    train = w.rowsBetween(Window.unboundedPreceding, -(gap + 1))
    made: dict[str, Column] = {"_i": F.row_number().over(w) - 1}
    made |= {f"_s_{c}": F.stddev_pop(dbl(c)).over(train) for c in cols}
    first = min_train + gap
    placed = df.select(*keys, "date", *cols).withColumns(made)
    medians = prefix_medians(placed, cols, "_i", gap + 1, first, keys)
    wide = medians.groupBy(*keys, "_i").agg(
        *[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(f"_m_{c}") for c in cols]
    )
    out = placed.where(F.col("_i") >= first).join(wide, [*keys, "_i"], "left")
    scaled = [
        (
            (F.coalesce(dbl(c), F.col(f"_m_{c}")) - F.col(f"_m_{c}"))
            / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
        ).alias(c)
        for c in cols
    ]
    return out.select(*keys, "date", (F.col("_i") - first).cast("long").alias("fold_idx"), *scaled)


def regression_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat", by: Keys = ()) -> DataFrame:
    """MAE, RMSE, R2 (0 without variance) and the share of equal signs, in one pass."""
    a, p = dbl(y), dbl(yhat)
    e = a - p
    sst = F.var_pop(a) * F.count(a)
    r2 = F.when(sst > 0, 1.0 - F.try_divide(F.sum(e * e), sst)).otherwise(0.0)
    same = F.avg((F.signum(a) == F.signum(p)).cast("double"))
    return df.where(a.isNotNull() & p.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        r2.alias("r2"),
        F.coalesce(same, F.lit(0.0)).alias("directional_accuracy"),
    )


def stability_selection(
    importances: DataFrame, top: int = 10, share: float = 0.7, fold: Keys = ("fold_idx",), keys: Keys = ()
) -> DataFrame:
    """Features among the ``top`` of a fold in at least ``share`` of the folds."""
    w = Window.partitionBy(*keys, *fold).orderBy(F.col("importance").desc(), F.col("feature"))
    hits = importances.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top)
    counted = hits.groupBy(*keys, "feature").agg(F.count("*").alias("n_hits"))
    folds = importances.select(*keys, *fold).distinct().groupBy(*keys).agg(F.count("*").alias("n_folds"))
    return attach(counted, folds, keys).where(F.col("n_hits") >= share * F.col("n_folds"))


ALPHAS = (0.3, 0.4, 0.5, 0.6, 0.7)


def blend_search(
    df: DataFrame, a: str, b: str, y: str, grid: Sequence[float] = ALPHAS, keys: Keys = (), min_rows: int = 5,
    accept: float = 1.15,
) -> DataFrame:
    """Blend weight of least MAE (the first of equals), 0.5 below ``min_rows`` common rows.

    All weights are scored in one aggregation. ``accepted`` tells whether the second model's
    own MAE is within ``accept`` times the first's.
    """
    common = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(y).isNotNull())
    mae = lambda x: F.avg(F.abs(x - dbl(y)))
    out = common.groupBy(*keys).agg(
        F.count("*").alias("n"),
        mae(dbl(a)).alias("mae_a"),
        mae(dbl(b)).alias("mae_b"),
        F.array(*[mae(w * dbl(a) + (1 - w) * dbl(b)) for w in grid]).alias("_m"),
    )
    # Rounded so that float noise cannot decide between equal weights.
    rounded = F.transform("_m", lambda x: F.round(x, 9))
    at = F.array_position(rounded, F.array_min(rounded)).cast("int")
    enough = F.col("n") >= min_rows
    return out.select(
        *keys,
        "n",
        "mae_a",
        "mae_b",
        F.when(enough, F.element_at(F.array(*[F.lit(float(w)) for w in grid]), at)).otherwise(0.5).alias("alpha"),
        F.when(enough, F.array_min("_m")).alias("blend_mae"),
        (F.col("mae_b") <= accept * F.col("mae_a")).alias("accepted"),
    )


def blend_predict(a: ColumnOrName, b: ColumnOrName, alpha: ColumnOrName | float) -> Column:
    """alpha * a + (1 - alpha) * b, or a alone where b is missing."""
    w = F.lit(float(alpha)) if isinstance(alpha, (int, float)) else dbl(alpha)
    return F.coalesce(w * dbl(a) + (1.0 - w) * dbl(b), dbl(a))


def time_split(df: DataFrame, share: float = 0.15, keys: Keys = SUBJECT, out: str = "is_validation") -> DataFrame:
    """Mark the last ``share`` of each series (at least one row) as validation."""
    n = F.count("*").over(Window.partitionBy(*keys))
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(day_number("date").desc()))
    held = df.withColumns({"_n": n, "_k": back})
    size = F.greatest(F.lit(1), F.floor(F.col("_n") * share).cast("int"))
    return held.withColumn(out, F.col("_k") <= size).drop("_n", "_k")


def score_normalise(
    raw: ColumnOrName, low: ColumnOrName, high: ColumnOrName, threshold: ColumnOrName, missing_ratio: ColumnOrName
) -> tuple[Column, Column]:
    """(normalised 0-1 score, anomaly flag): lower raw scores are more anomalous, and missing
    features damp the score by up to half."""
    s, lo, hi = dbl(raw), dbl(low), dbl(high)
    unit = F.when(hi > lo, 1.0 - F.try_divide(s - lo, hi - lo)).otherwise(0.5)
    clipped = F.when(s.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), unit)))
    return clipped * (1.0 - 0.5 * dbl(missing_ratio)), s < dbl(threshold)


REACH = 14.0  # log(1 + theta * largest excess) is searched within +- REACH
STEP = 1.0
ROUNDS = 6
CELLS = 8
WHOLE = "_whole"  # key of a table without keys


def _by_moments(excesses: DataFrame, keys: Keys) -> DataFrame:
    """Closed form over two sums."""
    x = F.col("_x")
    ratio = F.try_divide(F.avg(x) * F.avg(x), F.var_pop(x))
    return excesses.groupBy(*keys).agg(
        F.count(x).alias("n_tail"), F.var_pop(x).alias("_v"),
        (0.5 * (1.0 - ratio)).alias("shape"), (0.5 * F.avg(x) * (ratio + 1.0)).alias("scale"),
    )


def _by_likelihood(excesses: DataFrame, keys: Keys) -> DataFrame:
    """Profile likelihood in one unknown, theta = shape / scale.

    With A = mean log(1 + theta x) and B = mean 1 / (1 + theta x) the best shape at theta is A, and the
    slope of the profile has the sign of (1 + A) B - 1. A grid over s = log(1 + theta max x) finds the
    best cell, each round keeps the eighth in which the slope turns negative, and a secant ends the
    search. A round is one map-side aggregate of sums per key. Shapes below -1 have no bounded
    likelihood; where none above is better, the tail is uniform up to its largest excess.
    """
    whole = list(keys) == [WHOLE]
    join = lambda stats: excesses.join(F.broadcast(stats) if whole else stats, list(keys))
    x, top = F.col("_x"), F.col("_top")
    fits = excesses.groupBy(*keys).agg(F.count(x).alias("n_tail"), F.var_pop(x).alias("_v"), F.max(x).alias("_top"))
    theta = lambda s: F.expm1(s) / top
    log_mean = lambda s: F.avg(F.log1p(theta(s) * x))

    slope = lambda s: (1.0 + log_mean(s)) * F.avg(1.0 / (1.0 + theta(s) * x)) - 1.0
    steep = lambda s: F.try_divide(slope(s), F.max(theta(s)) * log_mean(s))
    heavy = F.avg(x * x) > 2.0 * F.avg(x) * F.avg(x)  # (1 + A) B - 1 has a double zero at theta = 0

    grid = [STEP * (i + 0.5) - REACH for i in range(int(2 * REACH / STEP))]  # never 0
    first = join(fits).where("_v > 0").groupBy(*keys).agg(
        F.max("_top").alias("_top"), *[log_mean(F.lit(s)).alias(f"_a{i}") for i, s in enumerate(grid)]
    )
    profile = [
        F.struct(
            F.when(F.col(f"_a{i}") >= -1, -F.log(F.col(f"_a{i}") / theta(F.lit(s))) - F.col(f"_a{i}")).alias("g"),
            F.lit(s).alias("s"),
        )
        for i, s in enumerate(grid)
    ]
    best = F.array_max(F.filter(F.array(*profile), lambda p: p.g.isNotNull())).s
    cell = first.select(*keys, "_top", (best - STEP).alias("_lo"), F.lit(2 * STEP).alias("_w"))
    for _ in range(ROUNDS):
        marks = [F.col("_lo") + F.col("_w") * (j / CELLS) for j in range(1, CELLS)]
        rising = [F.when(F.abs(F.max(m)) < 1e-6, heavy).otherwise(slope(m) > 0) for m in marks]
        counted = join(cell).groupBy(*keys).agg(
            F.max("_top").alias("_top"), F.max("_lo").alias("_lo"), F.max("_w").alias("_w"), F.array(*rising).alias("_up")
        )
        last = F.coalesce(F.array_max(F.transform("_up", lambda up, i: F.when(up, i + 1))), F.lit(0))
        cell = counted.select(
            *keys, "_top", (F.col("_lo") + F.col("_w") * last / CELLS).alias("_lo"), (F.col("_w") / CELLS).alias("_w")
        )
    sides = join(cell).groupBy(*keys).agg(
        F.max("_top").alias("_top"), F.max("_lo").alias("_lo"), F.max("_w").alias("_w"),
        steep(F.col("_lo")).alias("_l"), steep(F.col("_lo") + F.col("_w")).alias("_r"),
    )
    share = F.when((F.col("_l") > 0) & (F.col("_r") < 0), F.try_divide("_l", F.col("_l") - F.col("_r"))).otherwise(0.5)
    root = sides.select(*keys, "_top", (F.col("_lo") + F.col("_w") * share).alias("_s"))
    s = F.col("_s")
    ends = join(root).groupBy(*keys).agg(
        F.max("_top").alias("_top"), F.max(theta(s)).alias("_theta"), log_mean(s).alias("_a"), F.avg(x).alias("_m")
    )
    uniform, flat = F.col("_a") < -1, F.abs("_a") < 1e-9
    solved = ends.select(
        *keys,
        F.when(uniform, -1.0).when(flat, 0.0).otherwise(F.col("_a")).alias("shape"),
        F.when(uniform, F.col("_top")).when(flat, F.col("_m")).otherwise(F.try_divide("_a", "_theta")).alias("scale"),
    )
    return fits.drop("_top").join(solved, list(keys), "left")


def pot_threshold(
    df: DataFrame, score: str = "score", contamination: float = 0.02, tail: float = 0.05, keys: Keys = (),
    method: str = "moments",
) -> DataFrame:
    """Peaks-over-threshold cut of the low tail under a generalised Pareto law.

    ``method="moments"`` fits by a closed form over two sums, ``"likelihood"`` by maximum likelihood;
    the latter also returns ``shape`` and ``scale`` and stages the excesses (the ``tail`` share of the
    rows) in the shared folder. Fewer than five excesses, or excesses without variance, fall back to
    the plain percentile (shape and scale NULL). NULL and NaN scores do not count; equal scores do.
    """
    if method not in ("moments", "likelihood"):
        raise ValueError(f"method must be 'moments' or 'likelihood', got {method!r}")
    wanted, keys = keys, list(keys) or [WHOLE]
    s = (df if wanted else df.withColumn(WHOLE, F.lit(0))).select(*keys, F.nanvl(dbl(score), F.lit(None)).alias(score))
    cut = quantiles_wide(s, [score], {"_tail": tail, "_plain": contamination}, wanted).withColumnsRenamed(
        {f"{score}__tail": "tail_threshold", f"{score}__plain": "_plain"}
    )
    low = attach(s, cut, wanted).where(F.col(score) <= F.col("tail_threshold"))
    excesses = low.select(*keys, (F.col("tail_threshold") - F.col(score)).alias("_x"))
    if method == "moments":
        fit = _by_moments(excesses, keys)
    else:
        fit = _by_likelihood(materialized(excesses, "excesses"), keys)
    shape, scale = F.col("shape"), F.col("scale")
    rare = F.lit(float(contamination))
    q = F.when(F.abs(shape) < 1e-9, -scale * F.log(rare)).otherwise(
        scale / F.when(F.abs(shape) >= 1e-9, shape) * (F.pow(rare, -shape) - 1.0)
    )
    usable = (F.col("n_tail") >= 5) & (F.col("_v") > 0)
    extra = [F.when(usable, c).alias(n) for n, c in (("shape", shape), ("scale", scale))] if method == "likelihood" else []
    out = (cut if wanted else cut.withColumn(WHOLE, F.lit(0))).join(fit, keys, "left")
    return out.select(
        *wanted, "tail_threshold", F.coalesce("n_tail", F.lit(0)).cast("long").alias("n_tail"), *extra,
        F.when(usable, F.col("tail_threshold") - q).otherwise(F.col("_plain")).alias("threshold"),
    )
