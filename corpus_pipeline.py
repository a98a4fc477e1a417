"""A training corpus from ``documents``: toxicity, exact copies, near copies, benchmark passages,
packing. Each stage's result is written to the shared folder and read again by the next.

Defined cases: a NULL, empty or blank text scores as the model's bias, is one group of exact copies, links
with nothing, holds no benchmark passage, and packs as its end token; rows with the same id and text stay
or go together and leave the second stage as one; rows without an id take part like others and come last
among copies; very long texts are read whole and cut into full sequences at the end; without labels, or with
one class, every document has the share of toxic rows as its score; columns that clash with names used
inside pass through unchanged; an empty table gives an empty result at every stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kymo.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from kymo.llm.catalog import table, vocabulary
from kymo.llm.frames import free
from kymo.session import materialized


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a factorization machine, fitted on the labelled ones, does not reject."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    name = free(docs, "toxicity")
    return toxicity.score(docs, machine, out=name).where(F.col(name) < 0.5).drop(name)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2,048 tokens."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), size=2048, end=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", benchmark),
    ("packing", packed),
]

#: The first stage is a learned model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
