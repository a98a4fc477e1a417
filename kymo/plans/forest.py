"""Isolation forest: bounded samples, trees grown in parallel, scoring per Arrow batch."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kymo.core import Keys, dbl, finite
from kymo.operators.quantiles import quantiles_wide
from kymo.plans import shapley
from kymo.plans.evaluation import pot_threshold, score_normalise
from kymo.session import materialized

# Draws are hashes below this bound.
HASHES = 1 << 62
#: Rows that walk the trees together.
BLOCK_ROWS = 256


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


NODE = T.StructType(
    [
        T.StructField("tree", T.IntegerType()),
        T.StructField("node", T.IntegerType()),
        T.StructField("feature", T.IntegerType()),
        T.StructField("split", T.DoubleType()),
        T.StructField("left", T.IntegerType()),
        T.StructField("right", T.IntegerType()),
        T.StructField("path", T.DoubleType()),
        T.StructField("cover", T.IntegerType()),
    ]
)


def grow_tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Random splits until a point is alone or the height limit; (feature, split, left,
    right, path, rows of the sample) per node, feature -1 marking a leaf with its path length."""
    nodes: list[tuple] = []
    work = [(x, 0, -1, 0)]
    while work:
        part, depth, parent, side = work.pop()
        at = len(nodes)
        if parent >= 0:
            f, s, left, right, *rest = nodes[parent]
            nodes[parent] = (f, s, at, right, *rest) if side == 0 else (f, s, left, at, *rest)
        low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (None, None)
        open_features = np.flatnonzero(high > low) if len(part) > 1 else np.array([], dtype=int)
        if depth >= limit or len(open_features) == 0:
            nodes.append((-1, 0.0, -1, -1, depth + float(average_path(np.array(len(part)))), len(part)))
            continue
        f = int(rng.choice(open_features))
        split = float(rng.uniform(low[f], high[f]))
        mask = part[:, f] < split
        nodes.append((f, split, -1, -1, 0.0, len(part)))
        work += [(part[~mask], depth + 1, at, 1), (part[mask], depth + 1, at, 0)]
    return nodes


@dataclass
class ForestModel:
    """Trees as padded arrays (at most trees x (2 psi - 1) nodes) and the training statistics."""

    cols: list[str]
    medians: dict[str, float]
    low: dict[str, float]
    high: dict[str, float]
    psi: int
    arrays: dict[str, np.ndarray]
    offset: float = 0.0
    score_min: float = 0.0
    score_max: float = 1.0
    threshold: float = 0.0
    version: str = ""
    extra: dict = field(default_factory=dict)

    def flat(self) -> dict[str, np.ndarray]:
        """All nodes in one row: feature, split, the two places that follow a node (a leaf's are its
        own), path length, and the bit of the feature that a node looks at."""
        a = self.arrays
        trees, width = a["feature"].shape
        first = (np.arange(trees) * width)[:, None]
        inner, own = a["feature"] >= 0, first + np.arange(width)
        follow = np.stack([np.where(inner, first + a["left"], own), np.where(inner, first + a["right"], own)], axis=2)
        f = np.maximum(a["feature"], 0).astype(np.int64)
        bit = np.where(inner, np.int64(1) << (f % 63), 0)
        return {"feature": f.ravel(), "split": a["split"].ravel(), "follow": follow.ravel(), "path": a["path"].ravel(), "bit": bit.ravel(), "roots": first.ravel()}

    def leaves(self, flat: dict, x: np.ndarray, rows: np.ndarray, node: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
        """The leaves below the nodes ``node`` of rows ``rows`` of ``x``; ``seen`` collects features."""
        x, at = np.ascontiguousarray(x).ravel(), rows * x.shape[1]
        for _ in range(self.arrays["height"]):
            if seen is not None:
                seen |= flat["bit"].take(node)
            left = x.take(at + flat["feature"].take(node)) < flat["split"].take(node)
            node = flat["follow"].take(2 * node + ~left)
        return node

    def blocks(self, x: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(rows, their numbers, roots) of blocks small enough for a processor's cache."""
        roots = np.arange(len(self.arrays["feature"])) * self.arrays["feature"].shape[1]
        for at in range(0, len(x), BLOCK_ROWS):
            n = min(BLOCK_ROWS, len(x) - at)
            yield slice(at, at + n), np.repeat(np.arange(n), len(roots)), np.tile(roots, n)

    def depth(self, x: np.ndarray) -> np.ndarray:
        flat, out = self.flat(), np.zeros(len(x))
        for part, rows, node in self.blocks(x):
            found = self.leaves(flat, x[part], rows, node)
            out[part] = flat["path"].take(found).reshape(-1, len(self.arrays["feature"])).mean(axis=1)
        return out

    def paths(self) -> tuple[list[shapley.Paths], float]:
        """The trees' paths, for Shapley values of the mean path length, and its expectation."""
        a, trees = self.arrays, len(self.arrays["feature"])

        def of(t: int):
            def split(n):
                if a["feature"][t, n] < 0:
                    return None
                left, right = int(a["left"][t, n]), int(a["right"][t, n])
                below = np.nextafter(a["split"][t, n], -np.inf)  # rows under the split go left
                return int(a["feature"][t, n]), float(below), left, right, a["cover"][t, left] / a["cover"][t, n]

            return shapley.walk_paths(0, split, lambda n: a["path"][t, n] / trees)

        return shapley.grouped(path for t in range(trees) for path in of(t))

    def decision(self, x: np.ndarray) -> np.ndarray:
        """Higher is more normal; the offset puts the contamination share below 0."""
        return self.scored(self.depth(x))

    def scored(self, depth: np.ndarray) -> np.ndarray:
        return -np.power(2.0, -depth / max(float(average_path(np.array(self.psi))), 1e-12)) - self.offset


def prepared(df: DataFrame, model: ForestModel) -> list:
    """Imputed and winsorised feature columns as expressions with the model's constants."""
    out = []
    for c in model.cols:
        x = F.coalesce(finite(c), F.lit(model.medians[c]))
        out.append(F.greatest(F.lit(model.low[c]), F.least(F.lit(model.high[c]), x)).alias(c))
    return out


def isolation_forest_train(
    df: DataFrame,
    cols: Sequence[str],
    trees: int = 200,
    psi: int = 256,
    contamination: float = 0.02,
    seed: int = 42,
    row_id: Sequence[str] = (),
) -> ForestModel:
    """Fit on the whole table's statistics; each tree draws ``psi`` rows of its own from the whole
    table, by a hash of ``row_id`` (a unique key) and the tree, which repeats exactly; without a
    key they are drawn at random. With fewer than ``psi`` rows every tree sees all of them, and
    path lengths are normalised by that number.

    Medians, winsor bounds, the offset and the thresholds are exact over all rows. Only the
    tree samples are bounded, as the method prescribes, so driver and task memory do not
    depend on the table.
    """
    cols = list(cols)
    df = materialized(df.select(*row_id, *[finite(c).alias(c) for c in cols]), "forest")
    q = quantiles_wide(df, cols, {"m": 0.5}).first()
    medians = {c: float(q[f"{c}_m"]) if q is not None and q[f"{c}_m"] is not None else 0.0 for c in cols}
    filled = df.select(*[F.coalesce(dbl(c), F.lit(medians[c])).alias(c) for c in cols])
    b = quantiles_wide(filled, cols, {"lo": 0.01, "hi": 0.99}).first()
    model = ForestModel(
        cols, medians, {c: float(b[f"{c}_lo"]) for c in cols}, {c: float(b[f"{c}_hi"]) for c in cols}, psi, {}
    )
    clean = filled.select(*prepared(filled, model))

    n = df.count()
    psi = model.psi = max(1, min(psi, n))
    key = F.xxhash64(*row_id, F.lit(seed)) if row_id else (F.rand(seed) * 2.0**62).cast("long")
    # A row keeps the trees whose hash is below a rate that gives each tree psi rows, with room for
    # chance (eight deviations); the rest is a rank over that bounded number.
    rate = min(1.0, (psi + 8.0 * math.sqrt(psi) + 32.0) / max(n, 1))
    draw = lambda tree: F.xxhash64("_key", tree, F.lit(seed)).bitwiseAND(F.lit(HASHES - 1))
    every = F.sequence(F.lit(0), F.lit(trees - 1))
    drawn = (
        df.withColumn("_key", key)
        .select("_key", *prepared(df, model))
        .withColumn("tree", F.explode(F.filter(every, lambda t: draw(t) <= F.lit(int(rate * HASHES)))))
        .withColumn("_draw", draw(F.col("tree")))
    )
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("_draw", *cols))
    samples = drawn.withColumn("_n", rank).where(F.col("_n") <= psi).select("tree", *cols)

    limit = max(1, math.ceil(math.log2(psi)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf[cols].sort_values(cols).to_numpy(dtype=float)
        nodes = grow_tree(x, np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(nodes, columns=["feature", "split", "left", "right", "path", "cover"])
        out.insert(0, "node", np.arange(len(out), dtype=np.int32))
        out.insert(0, "tree", np.int32(tree))
        return out

    grown = samples.groupBy("tree").applyInPandas(grow, NODE).toPandas()
    width = int(grown["node"].max()) + 1
    arrays: dict = {"height": limit}
    for name, kind, empty in (
        ("feature", np.int32, -1), ("split", float, 0.0), ("left", np.int32, 0), ("right", np.int32, 0), ("path", float, 0.0),
        ("cover", np.int32, 0),
    ):
        a = np.full((trees, width), empty, dtype=kind)
        a[grown["tree"].to_numpy(), grown["node"].to_numpy()] = grown[name].to_numpy()
        arrays[name] = a
    model.arrays = arrays

    scores = materialized(_score(clean, model, [], "score"), "scores")
    model.offset = float(quantiles_wide(scores, ["score"], {"o": contamination}).first()["score_o"])
    shifted = scores.select((F.col("score") - F.lit(model.offset)).alias("score"))
    ends = shifted.agg(F.min("score").alias("a"), F.max("score").alias("b")).first()
    model.score_min, model.score_max = float(ends["a"]), float(ends["b"])
    model.threshold = float(pot_threshold(shifted, "score", contamination).first()["threshold"])
    model.version = f"forest_{trees}x{psi}_{seed}"
    return model


def _score(df: DataFrame, model: ForestModel, keep: Sequence[str], out: str) -> DataFrame:
    cols = model.cols
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*[df.schema[k] for k in keep], T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            res = pdf[list(keep)].copy()
            res[out] = m.decision(pdf[cols].to_numpy(dtype=float))
            yield res

    return df.select(*keep, *prepared(df, model)).mapInPandas(run, schema)


def isolation_forest_score(df: DataFrame, model: ForestModel, keys: Keys) -> DataFrame:
    """(keys, raw score, normalised score, flag). The keys must not be feature columns."""
    missing = sum((F.col(c).isNull().cast("int") for c in model.cols), F.lit(0)) / float(len(model.cols))
    tagged = df.select(*keys, *model.cols, missing.alias("_missing"))
    raw = _score(tagged, model, [*keys, "_missing"], "anomaly_score")
    return raw.select(*keys, "anomaly_score", *_flagged(model))


def _flagged(model: ForestModel) -> list[Column]:
    """Normalised score and flag of rows with anomaly_score and _missing."""
    unit, flag = score_normalise(
        "anomaly_score", F.lit(model.score_min), F.lit(model.score_max), F.lit(model.threshold), "_missing"
    )
    return [unit.alias("normalized_score"), flag.alias("is_anomaly")]


def ablation_attribution(df: DataFrame, model: ForestModel, keys: Keys, scores: bool = False) -> DataFrame:
    """Per-row contributions: score change when one feature is set to its median. ``scores`` adds
    the columns of ``isolation_forest_score``, from the same pass. Each feature is ablated alone;
    ``shapley_attribution`` shares out what features do together."""
    return _attributed(df, model, keys, scores, _ablations)


def shapley_attribution(df: DataFrame, model: ForestModel, keys: Keys, scores: bool = False) -> DataFrame:
    """Per-row Shapley values of the mean path length: they add up to the row's path length less the
    expectation over the trees' samples. ``scores`` as above."""
    groups, _ = model.paths()
    return _attributed(df, model, keys, scores, lambda m, paths, x, full: shapley.shapley_values(paths, x), groups)


def _ablations(m: ForestModel, _, x: np.ndarray, full: np.ndarray) -> np.ndarray:
    """A tree is walked again for the features that the row meets in it, others cannot change its leaf."""
    delta, flat = np.zeros_like(x), m.flat()
    trees = len(m.arrays["feature"])
    for part, rows, node in m.blocks(x):
        y, seen = x[part].copy(), np.zeros(len(rows), np.int64)
        paths = flat["path"].take(m.leaves(flat, y, rows, node, seen))
        for j, c in enumerate(m.cols):
            kept, typical = y[:, j].copy(), m.medians[c]
            again = np.flatnonzero((seen >> (j % 63) & 1).astype(bool) & (kept != typical)[rows])
            if len(again):
                y[:, j] = typical
                now = paths.copy()
                now[again] = flat["path"].take(m.leaves(flat, y, rows[again], node[again]))
                changed = np.unique(rows[again])
                depth = now.reshape(-1, trees)[changed].mean(axis=1)
                delta[part.start + changed, j] = full[part][changed] - m.scored(depth)
                y[:, j] = kept
    return delta


def _attributed(df: DataFrame, model: ForestModel, keys: Keys, scores: bool, values, more=None) -> DataFrame:
    """keys, contributions by ``values`` of prepared rows and their scores. Negative means the
    feature pushes the row toward an anomaly. Rows stay in their Arrow batch, so nothing is
    shuffled; only numbers cross to Python, the structs are built in the JVM.
    """
    cols = model.cols
    shared = df.sparkSession.sparkContext.broadcast((model, more))
    raw_cols = [f"_raw{j}" for j in range(len(cols))]
    delta_cols = [f"_delta{j}" for j in range(len(cols))]
    schema = T.StructType(
        [
            *[df.schema[k] for k in keys],
            *[T.StructField(c, T.DoubleType()) for c in ("_missing", *raw_cols, *delta_cols, "anomaly_score")],
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, more = shared.value
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype=float)
            full = m.decision(x)
            delta = pd.DataFrame(values(m, more, x, full), columns=delta_cols, index=pdf.index)
            yield pd.concat([pdf[[*keys, "_missing", *raw_cols]], delta], axis=1).assign(anomaly_score=full)

    missing = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0)) / float(len(cols))
    raws = [dbl(c).alias(r) for c, r in zip(cols, raw_cols)]
    source = df.select(*keys, missing.alias("_missing"), *raws, *prepared(df, model))
    items = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), finite(r).alias("value"), F.col(d).alias("contribution"))
            for c, r, d in zip(cols, raw_cols, delta_cols)
        ]
    )
    out = source.mapInPandas(run, schema)
    if not scores:
        return out.select(*keys, items.alias("contributions"))
    return out.select(*keys, "anomaly_score", *_flagged(model), items.alias("contributions"))
