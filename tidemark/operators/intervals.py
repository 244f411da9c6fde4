"""Interval operators: merging overlaps, and greedy budgets over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or touching intervals of a key as one: islands between gaps in the running end."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("_new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1)))
    island = opened.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("merged")).drop("_island")


def within_budget(rows: DataFrame, keys: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """The leading rows of each key whose sizes add up to the budget at most."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_used", F.sum(size).over(w)).where(F.col("_used") <= budget).drop("_used")
