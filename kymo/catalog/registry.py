"""The query registry: name -> (DataFrame builder over the stand-in views, check SQL)."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from kymo.core import round_doubles
from kymo.fixtures import Views, with_views

MODULES = ("filters", "joins", "aggregates", "frames", "reconcile", "scalars", "sources", "composites", "models", "streams")


@dataclass(frozen=True)
class Entry:
    build: Callable[[Views], DataFrame]
    check: str | None
    digits: int


ENTRIES: dict[str, Entry] = {}


def query(name: str, check: str | None = None, digits: int = 6):
    def register(fn: Callable[[Views], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"query {name!r} registered twice")
        ENTRIES[name] = Entry(fn, check, digits)
        return fn

    return register


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"kymo.catalog.{m}")


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = ENTRIES[name]
    return round_doubles(entry.build(Views(spark, sf_dir)), entry.digits)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {n: (lambda spark, sf_dir, _n=n: run(_n, spark, sf_dir)) for n in ENTRIES}


def oracle_sql() -> dict[str, str]:
    _load()
    return {n: with_views(e.check) for n, e in ENTRIES.items() if e.check}


# Check-SQL fragments.
DAYNO = "(date - DATE '1970-01-01')"


def cal(days: int, today: bool = False, key: str = "subject_id") -> str:
    """Calendar frame of the check engine."""
    end = "CURRENT ROW" if today else "1 PRECEDING"
    return f"OVER (PARTITION BY {key} ORDER BY {DAYNO} RANGE BETWEEN {days} PRECEDING AND {end})"


def rows(n: int, today: bool = False, key: str = "subject_id") -> str:
    end = "CURRENT ROW" if today else "1 PRECEDING"
    return f"OVER (PARTITION BY {key} ORDER BY {DAYNO} ROWS BETWEEN {n} PRECEDING AND {end})"


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits})"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def flags(*named: tuple[str, str]) -> str:
    """Comma-joined names of the conditions that hold."""
    items = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in named)
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), ',')"
