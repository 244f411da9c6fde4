"""Named queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import entities, parsing, records, relational, reporting, serving, upkeep  # noqa: F401  (they add their queries)
from tidemark.plans.views import with_views

_ALL = relational.Q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, (_, sql) in _ALL.items() if sql}
