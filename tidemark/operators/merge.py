"""Authority-aware merge of documents into one record per entity, with conflicts, without a fold.

``fields`` is long: entity, seq, field, value (text), authority (smaller is stronger). A null value
says nothing; the first known value fills a gap; a later different one replaces it only with at
least the best authority so far, and is recorded as a conflict either way where the field is one
whose conflicts count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import normalise

#: Fields whose differing values are recorded.
CONFLICT_FIELDS = ("registration_start", "registration_deadline", "exam_date", "application_fee", "fee_exemption_deadline",
                   "payment_deadline", "edital_number", "organizing_board", "salary", "vacancies", "weekly_workload", "education")


#: Fields that hold numbers.
NUMBERS = ("application_fee", "salary", "vacancies", "weekly_workload", "daily_workload", "reserve_count")


def authority(trust: Column, from_table: Column) -> Column:
    return trust * 10 + F.when(from_table, 0).otherwise(5)


#: Fields that hold truth values.
TRUTHS = ("assignment_confirmed",)


def _items(value: Column) -> Column:
    """The normal form of a JSON list with a word between its items that no other list has there; null for what is no list."""
    return normalise(F.array_join(F.from_json(value, "array<string>"), " 0item0 ", "None"))


def same(a: Column, b: Column, field: Column) -> Column:
    """Equal values: numbers of number fields within 0.005, truth values as such, lists item by item in normal form and
    in order, everything else in normal form."""
    x, y = a.try_cast("double"), b.try_cast("double")
    t, u = a.try_cast("boolean"), b.try_cast("boolean")
    lists = a.startswith("[") & b.startswith("[") & _items(a).isNotNull() & _items(b).isNotNull()
    empty = r"^\[\s*\]$"
    return (F.when(field.isin(*NUMBERS) & x.isNotNull() & y.isNotNull(), F.abs(x - y) < 0.005).when(field.isin(*TRUTHS) & t.isNotNull() & u.isNotNull(), t == u)
            .when(lists, (a.rlike(empty) == b.rlike(empty)) & (_items(a) == _items(b))).otherwise(normalise(a) == normalise(b)))


def _candidates(fields: DataFrame) -> DataFrame:
    w = Window.partitionBy("entity", "field").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    best = F.coalesce(F.min("authority").over(before), F.col("authority"))
    seen = F.coalesce(F.count("value").over(before), F.lit(0)) > 0
    step = fields.withColumn("better", F.col("authority") <= best).withColumn("cand", F.col("value").isNotNull() & (~seen | F.col("better")))
    current = F.last(F.when(F.col("cand"), F.col("value")), ignorenulls=True).over(before)
    return step.withColumn("current", current).withColumn(
        "starts", F.col("cand") & (F.col("current").isNull() | ~same(F.col("current"), F.col("value"), F.col("field"))))


def merged(fields: DataFrame) -> DataFrame:
    """entity, field, value, authority, seq: the value that holds after all documents."""
    return _candidates(fields).where("starts").groupBy("entity", "field").agg(
        F.max_by("value", "seq").alias("value"), F.max_by("authority", "seq").alias("authority"), F.max("seq").alias("seq"))


def conflicts(fields: DataFrame, keep: int = 60) -> DataFrame:
    """entity, seq, field, old_value, new_value, replaced: the last ``keep`` of an entity."""
    w = Window.partitionBy("entity").orderBy(F.desc("seq"), F.desc("field"))
    found = _candidates(fields).where(F.col("field").isin(*CONFLICT_FIELDS) & F.col("value").isNotNull() & F.col("current").isNotNull()
                                      & ~same(F.col("current"), F.col("value"), F.col("field")))
    return found.select("entity", "seq", "field", F.col("current").alias("old_value"), F.col("value").alias("new_value"),
                        F.col("cand").alias("replaced"), F.row_number().over(w).alias("n")).where(F.col("n") <= keep).drop("n")


def running(fields: DataFrame) -> DataFrame:
    """entity, seq, field, value: what held after each document (the version history)."""
    w = Window.partitionBy("entity", "field").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    c = _candidates(fields)
    return c.select("entity", "seq", "field", F.last(F.when(F.col("cand") & F.col("starts"), F.col("value")), ignorenulls=True).over(w).alias("value"))


def without_placeholders(positions: DataFrame) -> DataFrame:
    """Positions of an entity; synthetic ones only where no real one exists."""
    real = F.max((~F.col("synthetic")).cast("int")).over(Window.partitionBy("entity")) == 1
    return positions.withColumn("_real", real).where("not (synthetic and _real)").drop("_real")


def merge_positions(positions: DataFrame) -> DataFrame:
    """One row per (entity, slug): first known values in order of seq, confirmation sticky."""
    w = F.struct("seq")
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), w)).alias(c)
    return without_placeholders(positions).groupBy("entity", "slug").agg(
        first("name"), first("salary"), first("weekly"), first("vacancies"), F.bool_or("confirmed").alias("confirmed"))
