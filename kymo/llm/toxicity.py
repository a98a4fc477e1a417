"""Toxicity by a factorization machine over hashed words.

A document is the set of its words and of their first ``STEM`` letters, hashed to 2^18 features;
each pair of features has a learned interaction, the product of two short vectors. So an insult next to a group's name can weigh more
than both alone, which additive weights miss. Features are presence, not frequency, so that one
word counts the same in a short and in a very long text; features seen in fewer than ``MIN_DOCS``
training rows are left out.

The fit uses at most ``max_rows`` distinct labelled texts, those with the smallest hashes, so the
sample is bounded and the same on every run; scoring covers every whole text.

Defined cases: a text without a word (NULL, empty, digits only) scores as the bias alone; labelled
rows without a label are not learned from; with no labelled rows, or one class only, the score is
the share of toxic rows (0.5 for none); repeated rows count once for the fit; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.llm.frames import give_back, released, settle

WORD = re.compile(r"[^\W\d_]+")
BITS, FACTORS, MIN_DOCS, STEM = 18, 8, 4, 4
#: Training rows, and their share, that a feature needs to take part in interactions: a pair must
#: have been seen together to tell anything.
MIN_PAIRED, MIN_SHARE = 20, 0.003
#: Soft thresholds of a gradient step of size one, of weights and of vectors.
LASSO, V_LASSO = 8e-3, 4e-3
#: Distinct words that a worker remembers; beyond that it forgets all and starts anew.
KNOWN = 250_000


class Features(dict):
    """Word -> feature, as 4 bytes."""

    def __missing__(self, word: str) -> bytes:
        feature = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) >> (32 - BITS)
        self[word] = code = feature.to_bytes(4, "little")
        return code

    def of(self, text: str | None) -> np.ndarray:
        """Distinct features of a text, in rising order."""
        if len(self) > KNOWN:
            self.clear()
        words = set(WORD.findall(text.lower())) if text else set()
        words |= {w[:STEM] + "*" for w in words if len(w) > STEM}
        return np.unique(np.frombuffer(b"".join([self[w] for w in words]), dtype="<u4")).astype(np.int32)


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum of w + sum over pairs of v . v)."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def margins(self, docs: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(d) for d in docs])
        out = np.full(len(docs), self.bias)
        full = np.flatnonzero(sizes)
        if len(full):
            x = np.concatenate([docs[i] for i in full])
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            out[full] += np.add.reduceat(self.w[x], starts)
            both = np.add.reduceat(self.v[x], starts, axis=0)
            own = np.add.reduceat(self.v[x] ** 2, starts, axis=0)
            out[full] += 0.5 * (both**2 - own).sum(axis=1)
        return out

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(docs), -35, 35)))


def fit(docs: list[np.ndarray], labels: np.ndarray, epochs: int = 8, rate: float = 0.1, seed: int = 7) -> FactorizationMachine:
    """Logistic loss, rows weighted so that both classes count alike, AdaGrad in small batches, and
    a soft threshold on the weights, which holds those of chance words at zero."""
    size = 1 << BITS
    rng = np.random.default_rng(seed)
    share = labels.mean() if len(labels) else 0.5
    machine = FactorizationMachine(0.0, np.zeros(size), np.zeros((size, FACTORS)))
    if share in (0.0, 1.0) or not len(labels):
        machine.bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return machine
    count = np.bincount(np.concatenate([*docs, np.zeros(0, np.int32)]), minlength=size)
    docs = [d[(count >= MIN_DOCS)[d]] for d in docs]
    paired = count >= max(MIN_PAIRED, MIN_SHARE * len(docs))
    machine.v[paired] = rng.normal(0, 0.02, (int(paired.sum()), FACTORS))
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    w_sum, v_sum, b_sum = np.full(size, 1e-2), np.full((size, FACTORS), 1e-5), 1e-2
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            some = [docs[i] for i in rows]
            error = (machine.scores(some) - labels[rows]) * weight[rows] / len(rows)
            g = float(error.sum())
            b_sum += g * g
            machine.bias -= rate * g / np.sqrt(b_sum)
            x = np.concatenate([*some, np.zeros(0, np.int32)])
            if not len(x):
                continue
            e = np.repeat(error, [len(d) for d in some])
            both = np.repeat(np.array([machine.v[d].sum(axis=0) for d in some]), [len(d) for d in some], axis=0)
            used, place = np.unique(x, return_inverse=True)
            gw, gv = np.zeros(len(used)), np.zeros((len(used), FACTORS))
            np.add.at(gw, place, e)
            np.add.at(gv, place, e[:, None] * (both - machine.v[x]))
            w_sum[used] += gw**2
            v_sum[used] += gv**2
            step = rate / np.sqrt(w_sum[used])
            w = machine.w[used] - step * gw
            machine.w[used] = np.sign(w) * np.maximum(np.abs(w) - step * LASSO, 0)
            step = rate / np.sqrt(v_sum[used])
            v = machine.v[used] - step * gv
            machine.v[used] = np.sign(v) * np.maximum(np.abs(v) - step * V_LASSO, 0) * paired[used, None]
    machine.w, machine.v = machine.w.astype(np.float32), machine.v.astype(np.float32)
    return machine


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        docs = [features.of(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("hash"), batch.column("label"), pa.array(docs, pa.list_(pa.int32()))],
            ["hash", "label", "features"],
        )


def _lists(rows: pa.Array) -> list[np.ndarray]:
    """The rows of a list array without nulls, as views."""
    ends, items = rows.offsets.to_numpy(), rows.values.to_numpy()
    return [items[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 12_000,
) -> FactorizationMachine:
    """Fit on at most ``max_rows`` distinct labelled texts, those with the smallest hashes. Texts
    are never shuffled: ids and hashes meet the labels, and the bounded choice goes back to the
    documents, which are cut to features on the executors. The sample is fitted on the driver."""
    text = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)")
    chosen = (
        text.select("id", "hash")
        .join(known, "id")
        .groupBy("hash", "label")
        .agg(F.min("id").alias("id"))
        .orderBy("hash", "label")
        .limit(max_rows)
    )
    sample = (
        text.join(F.broadcast(chosen), ["id", "hash"])
        .select("hash", "label", "text")
        .mapInArrow(released(_featured), "hash long, label int, features array<int>")
        .dropDuplicates(["hash", "label"])
        .orderBy("hash", "label")
        .toArrow()
    )
    # views of the Arrow buffers: lists of Python numbers would take ten times their bytes
    rows = [d for part in sample.column("features").chunks for d in _lists(part)]
    machine = fit(rows, sample.column("label").to_numpy().astype(np.float64))
    del rows, sample
    settle(docs.sparkSession)
    return machine


def score(docs: DataFrame, machine: FactorizationMachine, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``, which replaces one of that name: the probability of label 1. The
    model is of a fixed size and goes to the executors once; texts go to the workers, scores come back."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features, model = Features(), shared.value
        for text in texts:
            parts = [model.scores([features.of(t) for t in text.slice(at, 512).to_pylist()]) for at in range(0, len(text), 512)]
            yield pa.array(np.concatenate([*parts, np.zeros(0)]))
        give_back()

    return docs.drop(out).withColumn(out, scored(F.col(text_col)))
