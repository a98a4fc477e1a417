"""Order statistics of growing prefixes without buffering a prefix.

The k-th smallest value among a series' first rows is found digit by digit. Values get their rank in
the whole series once; a query (position, k) starts at the root of a 16-ary tree over those ranks. On
each level the running counts of the 16 children at the query's position name the child that holds
the k-th value, and points and queries move on to their children. Every level is one window of
running counts, so the work is rows x levels, and levels grow with the logarithm of the longest series.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kymo.core import Keys, dbl

BITS = 4
FAN = 1 << BITS


def tree_levels(longest: int) -> int:
    """Levels of a 16-ary tree with a leaf for each of ``longest`` ranks."""
    return max(1, -(-max(longest - 1, 1).bit_length() // BITS))


def _descend(rows: DataFrame, level: int, group: Sequence[str]) -> DataFrame:
    """One level: points go to their own child, queries to the child that holds their k-th value."""
    path = Window.partitionBy(*group, "_node").orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    digit = F.shiftright("_rank", BITS * level).bitwiseAND(F.lit(FAN - 1))
    counts = {f"_c{d}": F.count(F.when(~F.col("_asks") & (digit <= d), 1)).over(path) for d in range(FAN - 1)}
    short: list[Column] = [(F.col(c) < F.col("_k")).cast("long") for c in counts]
    child = reduce(lambda a, b: a + b, short)
    below = F.greatest(F.lit(0), *[F.when(F.col(c) < F.col("_k"), F.col(c)).otherwise(0) for c in counts])
    went = F.when(F.col("_asks"), child).otherwise(digit)
    return rows.withColumns(counts).withColumns(
        {"_node": F.col("_node") * FAN + went, "_k": F.when(F.col("_asks"), F.col("_k") - below)}
    ).drop(*counts)


def prefix_medians(
    df: DataFrame, cols: Sequence[str], position: str, back: int, first: int, keys: Keys
) -> DataFrame:
    """Median of each column over the rows at least ``back`` positions earlier.

    ``position`` numbers the rows of a key from 0 without gaps. One row per (keys, position >= ``first``,
    column) whose prefix holds a value: ``feature`` and ``median``; NULL and NaN values do not count.
    Counts the rows of each key once, before the plan is made, to size the tree.
    """
    longest = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    group = [*keys, "feature"]
    values = F.array(*[F.struct(F.lit(c).alias("feature"), dbl(c).alias("x")) for c in cols])
    long = df.select(*keys, F.col(position).cast("long").alias("_at"), F.explode(values).alias("_v")).select(
        *keys, "_at", "_v.feature", F.nanvl("_v.x", F.lit(None)).alias("_x")
    )
    # The k-th value is asked for at the last position of the prefix; a prefix of even size asks twice.
    earlier = Window.partitionBy(*group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -back)
    middle = F.floor((F.col("_m") + 1) / 2), F.floor(F.col("_m") / 2) + 1
    asked = long.withColumn("_m", F.count("_x").over(earlier)).where((F.col("_at") >= first) & (F.col("_m") > 0))
    queries = asked.select(
        *group, (F.col("_at") - back).alias("_at"), F.lit(True).alias("_asks"), F.lit(None).cast("long").alias("_rank"),
        F.lit(None).cast("double").alias("_x"), F.explode(F.array_distinct(F.array(*middle))).alias("_k"),
    )
    by_value = Window.partitionBy(*group).orderBy("_x", "_at")
    points = long.where(F.col("_x").isNotNull()).select(
        *group, "_at", F.lit(False).alias("_asks"), (F.row_number().over(by_value) - 1).cast("long").alias("_rank"),
        "_x", F.lit(None).cast("long").alias("_k"),
    )
    rows = points.unionByName(queries).withColumn("_node", F.lit(0).cast("long"))
    for level in reversed(range(tree_levels(longest))):
        rows = _descend(rows, level, group)
    # A leaf holds one point and it comes before its queries.
    leaf = Window.partitionBy(*group, "_node").orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_x", F.max("_x").over(leaf)).where("_asks")
    return found.groupBy(*group, (F.col("_at") + back).alias(position)).agg(F.avg("_x").alias("median"))
