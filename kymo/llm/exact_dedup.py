"""Exact duplicates against a persistent digest index.

The index is a table of (digest, keep_id), bucketed and sorted by digest. New data is reduced to
one row per digest (map-side first), freed of known digests by a sort-merge anti-join that reads
the index bucket by bucket, and appended.

Defined cases: a NULL text counts as empty, so empty and NULL texts are one group. Of equal texts
the smallest id stays, NULL ids last. Repeated rows (same id and text) are one document: the query
marks each of them kept, ``drop_duplicates`` returns one. An empty table gives an empty result and
leaves the index as it is. Extra columns pass through ``drop_duplicates`` unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kymo.llm.frames import free
from kymo.session import materialized, stage_path

WHITE = r"[\x20\x09-\x0D]+"


def normal_text(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; NULL becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def text_digest(text: Column) -> Column:
    return F.sha2(normal_text(text), 256)


class DigestIndex:
    """Digests seen so far, as a bucketed table at ``path``. Opening a path that already holds an
    index registers it again, so that it outlives the session."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32, id_type: str = "bigint"):
        self.spark = spark
        self.path = path
        self.table = "digests_" + "".join(c if c.isalnum() else "_" for c in path)[-80:].lower()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest string, keep_id {id_type}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        self.buckets = buckets

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def ingest(self, digests: DataFrame) -> None:
        """Append the digests of ``digests`` (digest, id) that the index does not hold yet, each
        with its smallest id. A batch that comes again after a failure adds nothing."""
        first = digests.groupBy("digest").agg(F.min("id").alias("keep_id"))
        fresh = first.join(self.entries().hint("merge"), "digest", "left_anti").select("digest", "keep_id")
        # one task a bucket, so that each batch adds one sorted file to a bucket
        (
            fresh.repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .option("path", self.path)
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.table)
        )


def in_order(digests: DataFrame, batches: int) -> list[DataFrame]:
    """``digests`` as batches of rising integer ids, the order in which copies must arrive for the
    smallest id to stay; rows without an id come last."""
    low, high = digests.agg(F.min("id"), F.max("id")).first()
    if low is None or batches < 2:
        return [digests]
    width = (high - low) // batches + 1
    known = [
        digests.where(F.col("id").between(low + i * width, min(high, low + (i + 1) * width - 1)))
        for i in range(batches)
    ]
    return [*known, digests.where(F.col("id").isNull())]


def groups(digests: DataFrame, index: DigestIndex, batches: Sequence[DataFrame] | None = None) -> DataFrame:
    """Bring ``digests`` into ``index``; one row per digest: digest, keep_id, group_size, and
    n_first, the number of rows that carry keep_id. The groups join the index bucket by bucket."""
    for batch in batches if batches is not None else [digests]:
        index.ingest(batch)
    sizes = digests.groupBy("digest", "id").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("digest").agg(
        F.sum("n").alias("group_size"), F.min_by("n", F.struct(F.col("id").isNull(), "id")).alias("n_first")
    )
    return materialized(sizes.join(index.entries().hint("merge"), "digest"), "digest-groups")


def exact_duplicates(
    docs: DataFrame,
    index: DigestIndex | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    batches: int = 1,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    digests, found = _matched(docs, index, id_col, text_col, batches)
    # a digest that a third of all rows share is split by the adaptive sort-merge join
    return digests.join(found, "digest").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def _matched(docs, index, id_col, text_col, batches):
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    index = index or DigestIndex(spark, stage_path(spark, "digest-index"), id_type=kind)
    digests = materialized(
        docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest")), "digests"
    )
    return digests, groups(digests, index, in_order(digests, batches) if batches > 1 else None)


def drop_duplicates(
    docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    _, found = _matched(docs, index, id_col, text_col, 1)
    digest, keep_id = free(docs, "text_digest"), free(docs, "kept_id")
    keep = found.select(F.col("digest").alias("other_digest"), F.col("keep_id").alias(keep_id), "n_first")
    ties = keep.where("n_first > 1").limit(1).count() > 0
    rows = docs.withColumn(digest, text_digest(F.col(text_col)))
    same = (F.col(digest) == keep["other_digest"]) & F.col(id_col).eqNullSafe(F.col(keep_id))
    left = rows.join(keep.drop("n_first"), same, "left_semi")
    if ties:  # repeated rows: same id and same text
        left = left.dropDuplicates([digest])
    return left.drop(digest)
