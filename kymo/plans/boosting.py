"""Boosted-tree forecast of the next morning's HRV z-score, on histograms of quantile bins."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kymo.core import SUBJECT, Keys, day_number, dbl, finite
from kymo.operators.quantiles import quantiles_wide
from kymo.plans import shapley
from kymo.plans.evaluation import time_split
from kymo.plans.histograms import EVALUATE, NO_SPLIT, TEST, TRAIN, Booster, Tree, binned, grow, quantile_edges
from kymo.plans.search import MedianPruner, ParzenSearch
from kymo.session import materialized

# Default settings.
DEFAULTS = {
    "max_depth": 3,
    "min_child": 10,
    "rate": 0.05,
    "subsample": 0.7,
    "columns": 0.7,
    "l2": 5.0,
    "rounds": 500,
    "patience": 20,
    "seed": 42,
}
# Ranges of the search (lowest, highest, kind).
RANGES = {
    "max_depth": (2, 4, "int"),
    "min_child": (5, 20, "int"),
    "rate": (0.01, 0.1, "log"),
    "subsample": (0.5, 0.8, "float"),
    "columns": (0.5, 0.8, "float"),
    "l2": (1.0, 10.0, "float"),
}


@dataclass
class BoostedModel:
    cols: list[str]
    medians: dict[str, float]
    sds: dict[str, float]
    low: dict[str, float]
    high: dict[str, float]
    edges: list[np.ndarray]
    params: dict
    trees: list[Tree] = field(default_factory=list)
    base: float = 0.0
    mae: float = 1.0
    version: str = "boosted"

    def scaled(self, c: str) -> Column:
        x = F.coalesce(finite(c), F.lit(self.medians[c]))
        x = F.greatest(F.lit(self.low[c]), F.least(F.lit(self.high[c]), x))
        return (x - F.lit(self.medians[c])) / F.lit(self.sds[c])

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Bin codes of scaled rows."""
        return np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes = self.codes(x)
        return self.base + sum((t.predict(codes) for t in self.trees), np.zeros(len(x)))

    def paths(self) -> tuple[list[shapley.Paths], float]:
        """The trees' paths over bin codes, for Shapley values."""

        def of(tree: Tree):
            inner = 2**tree.depth - 1

            def split(at):
                if at >= inner or tree.cut[at] == NO_SPLIT:
                    return None
                left = tree.cover[2 * at + 1]
                return int(tree.feature[at]), float(tree.cut[at]), 2 * at + 1, 2 * at + 2, left / tree.cover[at]

            def value(at):
                while at < inner:
                    at = 2 * at + 1
                return tree.value[at - inner]

            return shapley.walk_paths(0, split, value)

        groups, expected = shapley.grouped(path for t in self.trees for path in of(t))
        return groups, self.base + expected


def _rows(x: pa.Array, width: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _statistics(df: DataFrame, cols: Sequence[str]) -> tuple[dict, dict, dict, dict]:
    q = quantiles_wide(df, cols, {"m": 0.5, "lo": 0.01, "hi": 0.99}).first()
    s = df.agg(*[F.stddev_pop(finite(c)).alias(c) for c in cols]).first()
    take = lambda suffix: {c: float(q[f"{c}_{suffix}"] or 0.0) for c in cols}
    return take("m"), {c: float(s[c] or 0.0) or 1.0 for c in cols}, take("lo"), take("hi")


def target_range(df: DataFrame, y: str, mult: float = 3.0) -> Column:
    """The outlier rule of ``iqr_outlier_filter`` over the whole table, with its two quartiles
    as constants so that later passes do not compute them again."""
    q = quantiles_wide(df, [y], {"q1": 0.25, "q3": 0.75}).first()
    if q is None or q[f"{y}_q1"] is None:
        return F.lit(True)
    q1, q3 = float(q[f"{y}_q1"]), float(q[f"{y}_q3"])
    return F.col(y).between(q1 - mult * (q3 - q1), q3 + mult * (q3 - q1))


def _prepared(rows: DataFrame, cols: list[str], y: str, keys: Keys, settings: dict, roles: Column) -> tuple[BoostedModel, DataFrame]:
    """An unfitted model with the statistics of ``rows``, and their binned form."""
    medians, sds, low, high = _statistics(rows, cols)
    model = BoostedModel(cols, medians, sds, low, high, [], settings)
    names = [f"x{i}" for i in range(len(cols))]
    scaled = rows.select(
        F.xxhash64(*keys, "date").alias("rid"), dbl(y).alias("y"), roles.alias("roles"), *(model.scaled(c).alias(n) for c, n in zip(cols, names, strict=True))
    )
    model.edges = quantile_edges(scaled, names)
    return model, binned(scaled, names, model.edges)


def _role(*cases: tuple[Column, int]) -> Column:
    out = F.lit(bytes([0]))
    for condition, role in cases:
        out = F.when(condition, F.lit(bytes([role]))).otherwise(out)
    return out


def gbt_fit(
    df: DataFrame,
    cols: Sequence[str],
    y: str,
    keys: Keys = SUBJECT,
    validation: float = 0.1,
    staged: bool = False,
    **params,
) -> BoostedModel:
    """Outlier filter on the target, median/winsor scaling, then boosting that stops after
    ``patience`` rounds without a better error on the last ``validation`` share of each series and
    keeps the rounds up to the best. One model over all subjects.

    The input is read several times, so it is written out first unless it is ``staged``.
    """
    cols = list(cols)
    settings = {**DEFAULTS, **params}
    source = df.where(F.col(y).isNotNull()).select(*keys, "date", *cols, y)
    if not staged:
        source = materialized(source, "boost")
    rows = source.where(target_range(source, y))
    marked = time_split(rows, validation, keys) if validation else rows.withColumn("is_validation", F.lit(False))
    marked = materialized(marked, "boost-marked")  # its windows once, not in each pass of the statistics
    roles = _role((~F.col("is_validation"), TRAIN), (F.col("is_validation"), EVALUATE))
    model, codes = _prepared(marked, cols, y, keys, settings, roles)
    [booster] = grow(codes, iter([Booster(0, settings)]), 1, len(cols), settings["rounds"], settings["patience"])
    model.trees, model.base = booster.trees[: booster.best], booster.base
    mae = booster.mae[booster.best] if len(booster.mae) > booster.best else math.nan
    model.mae = mae if mae == mae else 1.0
    model.version = f"boosted_{len(model.trees)}x{settings['max_depth']}_{settings['seed']}"
    return model


def gbt_predict(df: DataFrame, model: BoostedModel, out: str = "predicted_zscore") -> DataFrame:
    width = len(model.cols)

    @F.arrow_udf("double")
    def predicted(x: pa.Array) -> pa.Array:
        return pa.array(model.predict(_rows(x, width)))

    return df.withColumn(out, predicted(F.array(*[model.scaled(c) for c in model.cols])))


def _contributions(df: DataFrame, model: BoostedModel, keys: Keys, values) -> DataFrame:
    """keys, contributions: array of (feature, value, contribution); ``values`` maps a block of
    scaled rows to contributions by feature."""
    width = len(model.cols)

    @F.arrow_udf("array<double>")
    def parts(x: pa.Array) -> pa.Array:
        found = values(_rows(x, width))
        return pa.ListArray.from_arrays(np.arange(0, found.size + 1, width, dtype=np.int32), pa.array(found.ravel()))

    scored = df.select(*keys, F.array(*[dbl(c) for c in model.cols]).alias("_raw"), parts(F.array(*[model.scaled(c) for c in model.cols])).alias("_parts"))
    names = F.array(*[F.lit(c) for c in model.cols])
    items = F.transform(
        "_parts", lambda p, j: F.struct(F.get(names, j).alias("feature"), F.get("_raw", j).alias("value"), p.alias("contribution"))
    )
    return scored.select(*keys, items.alias("contributions"))


def gbt_ablation(df: DataFrame, model: BoostedModel, keys: Keys) -> DataFrame:
    """Contribution of each feature: prediction minus the prediction with it at its median. A tree
    is evaluated again for its own features only."""

    def values(x: np.ndarray) -> np.ndarray:
        codes, typical = model.codes(x), model.codes(np.zeros((1, x.shape[1])))[0]
        out = np.zeros(x.shape)
        for tree in model.trees:
            whole = tree.predict(codes)
            for j in np.unique(tree.feature[tree.cut != NO_SPLIT]):
                changed = codes.copy()
                changed[:, j] = typical[j]
                out[:, j] += whole - tree.predict(changed)
        return out

    return _contributions(df, model, keys, values)


def gbt_shapley(df: DataFrame, model: BoostedModel, keys: Keys) -> DataFrame:
    """Shapley value of each feature: they add up to the prediction less its expectation."""
    groups, _ = model.paths()
    return _contributions(df, model, keys, lambda x: shapley.shapley_values(groups, model.codes(x).astype(float)))


def blocked_folds(df: DataFrame, n_folds: int = 3, min_train: float = 0.4, gap: int = 1, keys: Keys = SUBJECT) -> DataFrame:
    """``_block``: 0 for the rows every fold trains on, then 1..n_folds in date order. Fold f
    trains on blocks before f and tests on f, without the first ``gap`` rows of f."""
    w = Window.partitionBy(*keys).orderBy(day_number("date"))
    at = (F.row_number().over(w) - 1) / F.count("*").over(Window.partitionBy(*keys))
    step = (1.0 - min_train) / n_folds
    block = F.when(at < min_train, 0).otherwise(F.least(F.lit(n_folds), F.floor((at - min_train) / step).cast("int") + 1))
    out = df.withColumn("_block", block)
    first = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(day_number("date")))
    return out.withColumn("_in_gap", (F.col("_block") > 0) & (first <= gap))


def _fold_roles(rows: DataFrame, n_folds: int, validation: float, keys: Keys) -> DataFrame:
    """``roles`` of rows with ``_block``: in fold f, blocks before f train, but for their last
    ``validation`` share, which tells when to stop; block f, without its gap, is the test."""
    out, roles = rows, []
    for f in range(1, n_folds + 1):
        mine = Window.partitionBy(*keys, F.col("_block") < f)
        back = F.row_number().over(mine.orderBy(day_number("date").desc()))
        size = F.greatest(F.lit(1), F.floor(F.count("*").over(mine) * validation).cast("int"))
        out = out.withColumn(f"_late{f}", (F.col("_block") < f) & (back <= size))
        tested = (F.col("_block") == f) & ~F.col("_in_gap")
        roles.append(_role((F.col("_block") < f, TRAIN), (F.col(f"_late{f}"), EVALUATE), (tested, TEST)))
    return out.withColumn("_roles", F.concat(*roles))


def param_search(
    df: DataFrame,
    cols: Sequence[str],
    y: str,
    grid: Mapping[str, Iterable] | Sequence[Mapping] | None = None,
    n_folds: int = 3,
    keys: Keys = SUBJECT,
    trials: int = 100,
    in_flight: int = 25,
    ranges: Mapping[str, tuple] = RANGES,
    validation: float = 0.1,
    seed: int = 42,
    prune: bool = True,
) -> list[tuple[dict, float]]:
    """Settings with their mean absolute error over expanding blocks, best first.

    ``trials`` settings are proposed over ``ranges``, each from the errors of those that have ended;
    or ``grid`` holds the values of each parameter, all combinations of which are tried, or the
    settings themselves. The folds of ``in_flight`` settings are boosted in the same passes over the
    rows. A setting that is worse at some round than the median of earlier ones ends there (with
    ``prune``) and has the error that it had. Outliers, medians and bins are those of the whole table.
    """
    if isinstance(grid, Mapping):
        names = list(grid)
        grid = [dict(zip(names, values, strict=True)) for values in itertools.product(*[list(grid[n]) for n in names])]
    cols = list(cols)
    source = df.where(F.col(y).isNotNull()).select(*keys, "date", *cols, y)
    blocks = materialized(blocked_folds(source, n_folds, keys=keys), "folds")
    marked = materialized(_fold_roles(blocks.where(target_range(blocks, y)), n_folds, validation, keys), "folds-marked")
    _, codes = _prepared(marked, cols, y, keys, DEFAULTS, F.col("_roles"))

    guide, pruner = ParzenSearch(ranges, seed), MedianPruner()
    asked: list[tuple[dict, list[Booster]]] = []
    told = 0

    def ended(boosters: list[Booster]) -> float:
        errors = [b.test_mae[b.best] for b in boosters if len(b.test_mae) > b.best and b.test_mae[b.best] == b.test_mae[b.best]]
        return sum(errors) / len(errors) if errors else math.inf

    def proposals() -> Iterator[Booster]:
        for number in range(trials if grid is None else len(grid)):
            params = guide.ask() if grid is None else dict(grid[number])
            folds = [Booster(number * n_folds + f, {**DEFAULTS, "seed": seed, **params}, f) for f in range(n_folds)]
            asked.append((params, folds))
            yield from folds

    waiting: dict[int, tuple[dict, list[Booster]]] = {}

    def report(active: list[Booster]) -> None:
        nonlocal told
        for number in range(told, len(asked)):
            waiting[number] = asked[number]
        told = len(asked)
        for number, (params, folds) in list(waiting.items()):
            live = [b for b in folds if not b.done]
            if prune and len(live) == n_folds and len({len(b.rmse) for b in live}) == 1 and all(b.level == 1 for b in live):
                now = [b.mae[-1] for b in live]
                if pruner.prune(len(live[0].trees), sum(now) / n_folds):
                    for b in live:
                        b.done = True
            if all(b.done for b in folds):
                del waiting[number]
                if grid is None:
                    guide.tell(params, ended(folds))

    grow(codes, proposals(), in_flight * n_folds, len(cols), DEFAULTS["rounds"], DEFAULTS["patience"], report)
    return sorted(((params, ended(folds)) for params, folds in asked), key=lambda r: r[1])
