"""Shapley values of tree ensembles, path by path.

A leaf counts for a set of known features with the product, over its path, of 1 or 0 for a known
feature (the row meets its conditions or not) and of the share of training rows that meet them for
an unknown one. The Shapley weights of all sets of a path are one integral over s in [0, 1] of the
product of ``(1 - s) * share + s * met``, a polynomial that Gauss points integrate exactly; so a path
with d features costs about d * d / 2 instead of 2^d. A row's values depend on the set of conditions
it meets alone, so short paths have all 2^d sets worked out once and rows look theirs up. Rows are
taken a block at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np

#: Numbers that a block of rows holds at once.
BLOCK = 100_000
#: Numbers that a group's table of all sets may hold; a group beyond it is worked out row by row.
TABLE = 8_000_000


@dataclass
class Paths:
    """Root-to-leaf paths with the same number of distinct features: ``feature``, the interval
    (``low``, ``high``] and the ``share`` of training rows for each, and the leaves' values."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray
    #: Values of the path's features for each set of met conditions, made when first asked for.
    table: np.ndarray | None = None

    def parts(self, met: np.ndarray) -> np.ndarray:
        """Shapley values (..., path, feature) where the conditions ``met`` (0 or 1) hold."""
        nodes, weights = np.polynomial.legendre.leggauss((self.feature.shape[1] + 1) // 2)
        total = np.zeros_like(met)
        for s, w in zip((nodes + 1) / 2, weights / 2, strict=True):
            term = (1 - s) * self.share + s * met
            total += w * term.prod(axis=-1, keepdims=True) / term
        return total * (met - self.share) * self.value[:, None]

    def by_set(self) -> np.ndarray:
        """``parts`` of all sets: row ``path * 2^d + set``, whose bit i says that condition i is met."""
        if self.table is None:
            p, d = self.feature.shape
            table = np.empty((p, 2**d, d))
            for number in range(2**d):
                table[:, number] = self.parts(np.broadcast_to((number >> np.arange(d) & 1).astype(float), (p, d)))
            self.table = table.reshape(-1, d)
        return self.table


def walk_paths(root, inner: Callable, leaf: Callable) -> Iterator[tuple[dict, float]]:
    """Conditions and value of each leaf. ``inner(node)`` is (feature, threshold, left, right, share
    of the node's rows to the left) or ``None`` for a leaf; ``leaf(node)`` its value."""
    todo = [(root, {})]
    while todo:
        node, met = todo.pop()
        split = inner(node)
        if split is None:
            yield met, leaf(node)
            continue
        f, at, left, right, share = split
        low, high, z = met.get(f, (-np.inf, np.inf, 1.0))
        todo.append((left, {**met, f: (low, min(high, at), z * share)}))
        todo.append((right, {**met, f: (max(low, at), high, z * (1 - share))}))


def grouped(paths: Iterable[tuple[dict, float]]) -> tuple[list[Paths], float]:
    """Paths by number of features, and the expectation: the value with no feature known."""
    by: dict[int, list] = {}
    expected = 0.0
    for met, value in paths:
        if any(z == 0 for _, _, z in met.values()):
            continue  # no training row, no share
        expected += value * float(np.prod([z for _, _, z in met.values()]))
        if met:
            by.setdefault(len(met), []).append((list(met), *zip(*met.values(), strict=True), value))
    out = []
    for some in by.values():
        f, low, high, share, value = zip(*some, strict=True)
        out.append(Paths(np.array(f), np.array(low, float), np.array(high, float), np.array(share, float), np.array(value, float)))
    return out, expected


def shapley_values(groups: list[Paths], x: np.ndarray) -> np.ndarray:
    """(rows, features) Shapley values of rows ``x``; with the expectation they add up to the value
    of the ensemble."""
    out = np.zeros(x.shape)
    for g in groups:
        p, d = g.feature.shape
        listed = p * d * 2**d <= TABLE
        bits, firsts = (1 << np.arange(d)), np.arange(p) * 2**d
        order = np.argsort(g.feature.ravel(), kind="stable")
        features, starts = np.unique(g.feature.ravel()[order], return_index=True)
        step = max(1, BLOCK // (p * d))
        for at in range(0, len(x), step):
            v = x[at : at + step].take(g.feature, axis=1)
            met = (v > g.low) & (v <= g.high)
            if listed:
                which = np.packbits(met, axis=2, bitorder="little")[:, :, 0] if d <= 8 else met @ bits
                total = g.by_set().take(which + firsts, axis=0)
            else:
                total = g.parts(met.astype(float))
            out[at : at + step, features] += np.add.reduceat(total.reshape(len(v), -1).take(order, axis=1), starts, axis=1)
    return out
