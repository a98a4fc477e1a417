"""Registered queries and their check SQL."""

from kymo.catalog.registry import ENTRIES, oracle_sql, queries

__all__ = ["ENTRIES", "oracle_sql", "queries"]
