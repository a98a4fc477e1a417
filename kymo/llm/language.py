"""Language identification with string kernels.

The kernel of two texts is the blended spectrum of byte n-gram presence: for n = 2, 3 and 4 the
share of common n-grams, normalised by the sizes of both sets, added up. A Nystroem map over
landmark texts turns it into features, on which kernel ridge regression is fitted one language
against the rest. Scoring is three matrix products a batch: presence by landmarks, the map, the
weights.

The fit uses at most ``per_lang`` distinct texts of each language, those with the smallest hashes,
and ``landmarks`` of them; scoring covers every whole text.

Defined cases: a text that is NULL or has no letter is ``und`` with score 0; rows without a language
are not learned from; with nothing learned every text is ``und``; repeated rows count once for the
fit; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
#: n-gram length -> bits of its presence vector.
SPECTRUM = {2: 12, 3: 13, 4: 13}
WIDTH = sum(1 << b for b in SPECTRUM.values())
#: ASCII letters and all bytes beyond ASCII stay; everything else separates words.
PLAIN = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
BATCH = 256


def presence(texts: list[str | None]) -> np.ndarray:
    """Presence of hashed n-grams, one row a text, n-gram lengths side by side."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for row, text in zip(out, texts, strict=True):
        if not text:
            continue
        b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass").translate(PLAIN), np.uint8).astype(np.uint32)
        base = 0
        for n, bits in SPECTRUM.items():
            if len(b) >= n:
                code = b[: len(b) - n + 1].copy()
                for j in range(1, n):
                    code <<= np.uint32(8)
                    code |= b[j : len(b) - n + 1 + j]
                code *= np.uint32(0x9E3779B1)
                code >>= np.uint32(32 - bits)
                row[base : base + (1 << bits)][code] = 1
            base += 1 << bits
    return out


def normalised(x: np.ndarray) -> np.ndarray:
    """Each spectrum scaled to length one, so that products of rows add up to the kernel."""
    base = 0
    for bits in SPECTRUM.values():
        part = x[:, base : base + (1 << bits)]
        part /= np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1))
        base += 1 << bits
    return x


@dataclass
class KernelClassifier:
    languages: list[str]
    landmarks: np.ndarray  # WIDTH x m
    weights: np.ndarray  # m x languages, the Nystroem map included
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        kernel = normalised(presence(texts)) @ self.landmarks
        margin = 4 * (kernel @ self.weights + self.bias)
        share = np.exp(margin - margin.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        known = [bool(t and LETTER.search(t)) for t in texts]
        return (
            [self.languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)],
            [float(s[i]) if k else 0.0 for s, i, k in zip(share, best, known, strict=True)],
        )


def fit(bits: list[bytes], languages: list[str], landmarks: int, ridge: float = 1e-2) -> KernelClassifier:
    """Ridge regression one against the rest in the Nystroem features; classes count alike."""
    names = sorted(set(languages))
    if not names:
        return KernelClassifier([], np.zeros((WIDTH, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    packed = np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1)
    x = normalised(np.unpackbits(packed, axis=1, count=WIDTH).astype(np.float32))
    y = np.array([names.index(n) for n in languages])
    each = max(1, landmarks // len(names))
    chosen = np.concatenate([np.flatnonzero(y == i)[:each] for i in range(len(names))])
    marks = x[chosen].T.copy()
    value, vector = np.linalg.eigh((marks.T @ marks).astype(np.float64))
    value = np.maximum(value, 1e-6)
    to_features = vector / np.sqrt(value)
    phi = (x @ marks).astype(np.float64) @ to_features
    weight = (len(y) / len(names) / np.bincount(y))[y][:, None]
    centre = (weight * phi).sum(axis=0) / weight.sum()
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    middle = (weight * target).sum(axis=0) / weight.sum()
    z = phi - centre
    beta = np.linalg.solve(z.T @ (weight * z) + ridge * len(y) * np.eye(len(chosen)) / len(chosen), z.T @ (weight * (target - middle)))
    return KernelClassifier(names, marks, (to_features @ beta).astype(np.float32), (middle - centre @ beta).astype(np.float32))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            some = batch.slice(at, BATCH)
            rows = np.packbits(presence(some.column("text").to_pylist()).astype(bool), axis=1)
            yield pa.RecordBatch.from_arrays(
                [some.column("hash"), some.column("lang"), pa.array([r.tobytes() for r in rows], pa.binary())],
                ["hash", "lang", "bits"],
            )


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_lang: int = 800,
    landmarks: int = 128,
) -> KernelClassifier:
    """Fit on rows of ``docs`` that have a language. Only hashes are ranked and shuffled; the
    bounded choice of texts becomes packed presence vectors on the executors."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    each = rows.groupBy("lang", "hash").agg(F.min("id").alias("id"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    chosen = each.withColumn("rank", rank).where(F.col("rank") <= per_lang).select("lang", "hash", "id")
    found = (
        rows.join(F.broadcast(chosen), (rows["lang"] == chosen["lang"]) & (rows["hash"] == chosen["hash"]) & rows["id"].eqNullSafe(chosen["id"]), "left_semi")
        .select("hash", "lang", "text")
        .mapInArrow(_packed, "hash long, lang string, bits binary")
        .dropDuplicates(["hash", "lang"])
        .orderBy("lang", "hash")
        .toArrow()
    )
    return fit(found.column("bits").to_pylist(), found.column("lang").to_pylist(), landmarks)


def identify(docs: DataFrame, model: KernelClassifier, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and lang_score, which replace columns of these names."""
    docs = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                some = batch.slice(at, BATCH)
                langs, scores = kernel.predict(some.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    [*some.schema.names, "lang_pred", "lang_score"],
                )

    more = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))
