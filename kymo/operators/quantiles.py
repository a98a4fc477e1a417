"""Exact quantiles that never hold a whole group in one aggregation buffer.

Spark's exact ``percentile`` keeps every distinct value of a group in one buffer. That is
fine for a series of calendar days and wrong for a feature over the whole table. Here a
bounded sketch brackets each wanted rank, rows outside the brackets are only counted, and
the few rows inside are ranked exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kymo.core import Keys

ACCURACY = 10_000
MARGIN = 3.0 / ACCURACY
SMALL = 20_000  # below this many values the bracket is the whole range


def _brackets(probs: Sequence[float]) -> list[float]:
    edges = []
    for p in probs:
        edges += [max(0.0, p - MARGIN), min(1.0, p + MARGIN)]
    return edges


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Keys = ()
) -> DataFrame:
    """Long result: keys, feature, p, value, n (non-NULL values). Linear interpolation.

    The sketch's rank error is at most n / ACCURACY, so a bracket of +-3/ACCURACY around a
    rank always holds the two order statistics needed, once n > SMALL.
    """
    columns = list(columns)
    edges = _brackets(probs)
    long = df.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
        ).alias("_f"),
    ).select(*keys, "_f.feature", "_f.x").where(F.col("x").isNotNull())
    group = [*keys, "feature"]

    sketch = long.groupBy(*group).agg(
        F.count("x").alias("n"),
        F.min("x").alias("_min"),
        F.max("x").alias("_max"),
        F.percentile_approx("x", [float(e) for e in edges], ACCURACY).alias("_q"),
    )
    wanted = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(float(p)).alias("p"),
                    F.when(F.col("n") <= SMALL, F.col("_min")).otherwise(F.col("_q")[2 * i]).alias("lo"),
                    F.when(F.col("n") <= SMALL, F.col("_max")).otherwise(F.col("_q")[2 * i + 1]).alias("hi"),
                )
                for i, p in enumerate(probs)
            ]
        )
    ).alias("_w")
    bounds = sketch.select(*group, "n", wanted).select(*group, "n", "_w.p", "_w.lo", "_w.hi")

    # Rows below a bracket are counted, rows inside are counted per value; both aggregate
    # map-side, so a group of any size shuffles only its bracket.
    # Without keys there are features x probs bounds, so a broadcast is bounded; with keys
    # the planner chooses and AQE splits a hot key.
    tagged = long.join(bounds if keys else F.broadcast(bounds), group).where(F.col("x") <= F.col("hi"))
    value = F.when(F.col("x") >= F.col("lo"), F.col("x"))
    counted = tagged.groupBy(*group, "p", "n", value.alias("x")).agg(F.count("*").alias("c"))
    inside = Window.partitionBy(*group, "p").orderBy(F.col("x").asc_nulls_first())
    cum = F.sum("c").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.select(*group, "p", "n", "x", "c", cum.alias("upto")).where(F.col("x").isNotNull())

    rank = (F.col("n") - 1) * F.col("p")
    low, high = F.floor(rank), F.ceil(rank)
    holds = lambda r: (F.col("upto") - F.col("c") <= r) & (r < F.col("upto"))
    picked = ranked.groupBy(*group, "p", "n").agg(
        F.max(F.when(holds(low), F.col("x"))).alias("_lo"),
        F.max(F.when(holds(high), F.col("x"))).alias("_hi"),
    )
    frac = rank - F.floor(rank)
    return picked.select(*group, "p", "n", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac).alias("value"))


def quantiles_wide(
    df: DataFrame, columns: Sequence[str], probs: dict[str, float], keys: Keys = ()
) -> DataFrame:
    """One row per key (one row in all without keys): ``{column}_{suffix}`` for each suffix."""
    long = exact_quantiles(df, columns, sorted(set(probs.values())), keys)
    picks = [
        F.max(
            F.when((F.col("feature") == c) & (F.col("p") == F.lit(float(p))), F.col("value"))
        ).alias(f"{c}_{suffix}")
        for c in columns
        for suffix, p in probs.items()
    ]
    return long.groupBy(*keys).agg(*picks)


def attach(df: DataFrame, stats: DataFrame, keys: Keys = ()) -> DataFrame:
    """Add one row of statistics per key to every row; a scalar subquery when there are no keys."""
    if keys:
        return df.join(stats, list(keys), "left")
    one = stats.select(F.struct(*stats.columns).alias("_stats")).scalar()
    return df.withColumn("_stats", one).select(*df.columns, "_stats.*")
