"""What each quality filter removes, alone and in every order, from relations of failing ids.

Each filter has one table with the ids that fail it (a partition each of ``failing``), bucketed by row
like the tables of documents. A
state holds, for each set of filters, the documents that survive it and those that it removes; an
anti-join of the survivors with the next filter's ids leaves the next survivors, a semi-join finds its
removals, and a semi-join of those removed earlier finds its redundancies. Survivors do not depend on
the order in which filters ran, so 2^5 sets serve all 120 orders. All tables have the same buckets: no
join shuffles, and only counts by part do.

Filters, on words ``[^\\x20\\x09-\\x0D]+`` and code points of the whole text:
A under 200 words; B under half of the words distinct; C over 2 in 100 characters are A-Z; D has one of
``#$%&*|``; E the text of a document with a smaller id.

Defined cases: a NULL text is empty; an empty text fails A alone (and E, if an earlier one is empty);
a row without an id fails no E and makes no other fail it; repeated rows count each, and so do rows
with the same id and different texts; a document is good or toxic if any of its labels says so; a NULL
source is the part ''; very long texts are read whole; extra columns are not read, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kymo.llm.frames import small
from kymo.session import materialized, stage_path

FILTERS = "ABCDE"
WHITE = r"[\x20\x09-\x0D]+"
#: Narrow rows that one bucket holds on average.
BUCKET_ROWS = 500_000


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that look at one text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < 200,
        "B": 100 * distinct < 50 * n,
        "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _repeats(rows: DataFrame) -> DataFrame:
    """``rows`` with fails_E: a smaller id has the same digest. Only digests that several ids share
    are joined back; one that a third of the rows share is split by the adaptive join."""
    ids = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    shared = small(materialized(ids.where("first < last").select("digest", "first"), "first-ids"))
    return rows.join(shared, "digest", "left").withColumn("fails_E", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))


class _Relations:
    """Tables bucketed by row key in the shared folder; ``close`` takes them out of the catalog."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, []

    def dealt(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` dealt out by bucket, not by key: a bucket is written by one task, into one file (one
        a value of ``by``), whatever the number of partitions. Tasks by key would each have rows of all
        buckets and leave partitions times buckets files, which every later join opens."""
        return df.repartitionByRange(self.buckets, F.pmod(F.hash(key), F.lit(self.buckets)))

    def store(self, df: DataFrame, name: str, key: str, by: list[str] | None = None) -> DataFrame:
        table = f"audit_{name}_{uuid.uuid4().hex}"
        self.names.append(table)
        writer = df.write.format("parquet").option("path", stage_path(self.spark, table))
        (writer.partitionBy(*by) if by else writer).bucketBy(self.buckets, key).sortBy(key).saveAsTable(table)
        return self.spark.table(table)

    def close(self) -> None:
        for table in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def _next(state: DataFrame, later: bool) -> DataFrame:
    """``state`` with each filter that may come ``next``; if ``later``, those after the last letter of
    the prefix, so that each set comes about once."""
    letters = F.transform(F.sequence(F.lit(0), F.lit(len(FILTERS) - 1)), lambda i: F.substr(F.lit(FILTERS), i + 1, F.lit(1)))
    last = F.substring("prefix", -1, 1)
    free = F.filter(letters, lambda f: f > last) if later else F.filter(letters, lambda f: ~F.contains("prefix", f))
    return state.withColumn("next", F.explode(free))


def _met(rows: DataFrame, failing: DataFrame, how: str) -> DataFrame:
    """Semi- or anti-join of ``rows`` with the ids that fail the filter ``next``. Its letter is not a
    join key, so that the tables' buckets are all that the join needs."""
    return rows.join(failing, (rows["key"] == failing["failed"]) & F.contains(rows["next"], failing["filter"]), how)


def _counts(state: DataFrame, failing: DataFrame) -> DataFrame:
    """Counts of all prefixes of ``state`` with each filter that may come next."""
    failed = _met(_next(state, later=False), failing, "left_semi")
    failed = failed.withColumn("kind", F.when(F.col("alive"), "removed").otherwise("redundant"))
    kept = _met(_next(state.where("alive"), later=True), failing, "left_anti")
    kept = kept.withColumns({"prefix": F.concat("prefix", "next"), "next": F.lit(""), "kind": F.lit("kept")})
    return _by_part(failed.unionByName(kept))


def _by_part(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("part", "kind", "prefix", F.col("next").alias("step"))
    return counts.agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def _longer(state: DataFrame, failing: DataFrame) -> DataFrame:
    """The state after one more filter: documents of each set of filters, alive or removed."""
    rows = _next(state, later=True)
    alive = rows.where("alive")
    dead = rows.where("NOT alive").unionByName(_met(alive, failing, "left_semi").withColumn("alive", F.lit(False)))
    rows = dead.unionByName(_met(alive, failing, "left_anti"))
    return rows.withColumn("prefix", F.concat("prefix", "next")).drop("next")


def set_counts(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """Counts by part: kind ('kept' by the filters of ``prefix``; 'removed' next by ``step``;
    'redundant' failures of ``step`` that ``prefix`` removed), prefix, step, n, good, toxic."""
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.sha2(F.coalesce(text, F.lit("")), 256).alias("digest"),
        *(c.alias(f"fails_{f}") for f, c in text_failures(text).items()),
        F.monotonically_increasing_id().alias("key"),
    )
    rows = _repeats(materialized(rows, "filters"))
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    rows = rows.join(marks, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    rows = materialized(rows.select("key", "part", "good", "toxic", *(f"fails_{f}" for f in FILTERS)), "audited")
    tables = _Relations(spark, max(8, -(-rows.count() // BUCKET_ROWS)))
    found = []
    try:
        everyone = rows.select("key", "part", "good", "toxic", F.lit("").alias("prefix"), F.lit(True).alias("alive"))
        ids = F.array_compact(F.array(*(F.when(F.col(f"fails_{f}"), F.lit(f)) for f in FILTERS)))
        ids = rows.select(F.col("key").alias("failed"), F.explode(ids).alias("filter"))
        failing = tables.store(tables.dealt(ids, "failed"), "failing", "failed", by=["filter"])
        state = tables.store(tables.dealt(everyone, "key"), "documents", "key")
        whole = _by_part(state.withColumns({"kind": F.lit("kept"), "next": F.lit("")}))
        found.append(materialized(whole, "audit-counts"))
        for size in range(len(FILTERS)):
            if size:
                state = tables.store(_longer(state, failing), f"after_{size}", "key")
            found.append(materialized(_counts(state, failing), "audit-counts"))
    finally:
        tables.close()
    counts = found[0]
    for more in found[1:]:
        counts = counts.unionByName(more)
    return materialized(counts.coalesce(1), "audit-counts")  # 192 rows a part at most


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley. ``columns`` as for ``set_counts``."""
    spark = docs.sparkSession
    counts = set_counts(docs, labels, **columns)
    # 80 rows a part: every set and the filter that comes next
    nexts = [f"{p}:{f}:{''.join(sorted(p + f))}" for k in range(len(FILTERS)) for p in map("".join, combinations(FILTERS, k)) for f in FILTERS if f not in p]
    grid = counts.where("kind = 'kept' AND prefix = ''").select("part", F.explode(F.split(F.lit(" ".join(nexts)), " ")).alias("next"))
    grid = grid.select("part", *(F.split("next", ":")[i].alias(c) for i, c in enumerate(("prefix", "filter", "after"))))
    kept = counts.where("kind = 'kept'").select("part", F.col("prefix").alias("after"), F.col("n").alias("kept"))
    for kind, names in (("removed", {"n": "removed", "good": "good_lost", "toxic": "toxic_lost"}), ("redundant", {"n": "redundant"})):
        some = counts.where(F.col("kind") == kind).select("part", "prefix", F.col("step").alias("filter"), *(F.col(c).alias(n) for c, n in names.items()))
        grid = grid.join(some, ["part", "prefix", "filter"], "left")
    grid = grid.join(kept, ["part", "after"], "left").fillna(0)
    weights = F.lit(0)
    for k in range(len(FILTERS)):
        weights = F.when(F.length("prefix") == k, factorial(k) * factorial(len(FILTERS) - 1 - k)).otherwise(weights)
    alone = F.length("prefix") == len(FILTERS) - 1
    totals = grid.groupBy("part", "filter").agg(
        F.sum(F.when(alone, F.col("removed")).otherwise(0)).alias("unique_fails"), F.sum(F.col("removed") * weights).alias("shapley")
    )
    orders = [("".join(o), i + 1, f, "".join(sorted(o[:i]))) for o in permutations(FILTERS) for i, f in enumerate(o)]
    orders = spark.createDataFrame(orders, "filter_order string, step int, filter string, prefix string")  # 600 rows
    return (
        grid.join(totals, ["part", "filter"])
        .join(F.broadcast(orders), ["prefix", "filter"])
        .select(
            "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
        )
    )
