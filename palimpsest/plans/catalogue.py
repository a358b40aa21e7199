"""The core queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.plans import changes, memory, order, pages, restoring, serving, store, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _part in (store, order, texts, memory, pages, restoring, serving, changes):
    QUERIES |= _part.QUERIES
    SQL |= getattr(_part, "SQL", {})
