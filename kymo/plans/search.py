"""A search guided by earlier trials: tree-structured Parzen estimator with median pruning.

Finished trials are split into the better share and the rest. Each parameter has a density over
either, a mixture of normals cut off at its range, one for each trial and a wide one for the range;
of ``candidates`` draws from the better density the one with the largest ratio of the two is tried
next. Trials in flight count among the rest, so that proposals made together keep apart.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping
from dataclasses import dataclass, field
from statistics import NormalDist, median

Ranges = Mapping[str, tuple[float, float, str]]


def drawn(trials: int, ranges: Ranges, seed: int = 42) -> list[dict]:
    """``trials`` settings drawn at random from the whole of ``ranges`` (lowest, highest, kind)."""
    rng = random.Random(seed)
    return [{n: _value(_place(rng.random(), *r), *r) for n, r in ranges.items()} for _ in range(trials)]


def _bounds(low: float, high: float, kind: str) -> tuple[float, float]:
    if kind == "int":  # each value has a unit of its own
        return low - 0.5, high + 0.5
    return (math.log(low), math.log(high)) if kind == "log" else (low, high)


def _place(u: float, low: float, high: float, kind: str) -> float:
    a, b = _bounds(low, high, kind)
    return a + u * (b - a)


def _value(x: float, low: float, high: float, kind: str):
    if kind == "int":
        return int(min(high, max(low, round(x))))
    return min(high, max(low, math.exp(x) if kind == "log" else x))


class _Density:
    """Mixture of cut-off normals around ``points`` and one over the whole of [a, b]."""

    def __init__(self, points: list[float], a: float, b: float):
        centres = sorted(points)
        edges = [a, *centres, b]
        # a kernel is as wide as the farther of its two neighbours, within bounds
        narrow = (b - a) / min(100.0, 1.0 + len(centres))
        wide = [min(b - a, max(narrow, x - edges[k], edges[k + 2] - x)) for k, x in enumerate(centres)]
        self.parts = [(NormalDist(x, w), x) for x, w in zip(centres, wide, strict=True)] + [(NormalDist((a + b) / 2, b - a), (a + b) / 2)]
        self.mass = [d.cdf(b) - d.cdf(a) for d, _ in self.parts]
        self.a, self.b = a, b

    def draw(self, rng: random.Random) -> float:
        part = rng.choice(self.parts)[0]
        low, high = part.cdf(self.a), part.cdf(self.b)
        u = min(1 - 1e-12, max(1e-12, low + rng.random() * (high - low)))
        return min(self.b, max(self.a, part.inv_cdf(u)))

    def log(self, x: float) -> float:
        return math.log(sum(d.pdf(x) / m for (d, _), m in zip(self.parts, self.mass, strict=True)) / len(self.parts) + 1e-300)


@dataclass
class ParzenSearch:
    """Proposes settings over ``ranges``; ``tell`` takes the error of a proposal (lower is better)."""

    ranges: Ranges
    seed: int = 42
    startup: int = 10
    candidates: int = 24
    share: float = 0.15
    told: list[tuple[dict, float]] = field(default_factory=list)
    pending: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self.rng = random.Random(self.seed)
        self.first = drawn(self.startup, self.ranges, self.seed)

    def ask(self) -> dict:
        asked = len(self.told) + len(self.pending)
        if asked < self.startup or len(self.told) < 2:
            setting = self.first[asked] if asked < self.startup else drawn(1, self.ranges, self.seed + asked)[0]
        else:
            ordered = [s for s, _ in sorted(self.told, key=lambda t: t[1])]
            n = max(1, math.ceil(self.share * len(ordered)))
            setting = {name: self._best(name, ordered[:n], ordered[n:] + self.pending) for name in self.ranges}
        self.pending.append(setting)
        return setting

    def _best(self, name: str, good: list[dict], rest: list[dict]):
        low, high, kind = self.ranges[name]
        a, b = _bounds(low, high, kind)
        inner = (lambda v: math.log(v)) if kind == "log" else float
        better, worse = (_Density([inner(s[name]) for s in some], a, b) for some in (good, rest))
        tried = [better.draw(self.rng) for _ in range(self.candidates)]
        return _value(max(tried, key=lambda x: better.log(x) - worse.log(x)), low, high, kind)

    def tell(self, setting: dict, error: float) -> None:
        self.pending.remove(setting)
        self.told.append((setting, error if error == error else math.inf))


@dataclass
class MedianPruner:
    """Whether a trial is worse at a step than the median of earlier trials at that step."""

    least_trials: int = 5
    every: int = 10
    seen: dict[int, list[float]] = field(default_factory=dict)

    def prune(self, step: int, error: float) -> bool:
        if not step or step % self.every or error != error:
            return False
        others = self.seen.setdefault(step, [])
        worse = len(others) >= self.least_trials and error > median(others)
        others.append(error)
        return worse
