"""Notification outbox: idempotent queueing, reminders, alerts and delivery transitions."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.score import TERMINAL, THRESHOLDS, fired_threshold
from tidemark.functions.text import idempotency_key

MAX_ATTEMPTS, BATCH = 5, 200


def queue(messages: DataFrame, channels: tuple[str, ...], stored: DataFrame) -> DataFrame:
    """A row per channel and key (key, category, created_at, ...) that is not stored yet."""
    rows = messages.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels]))).withColumn("key", F.concat_ws(":", "channel", "key"))
    one = rows.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("created_at"))).where("_n = 1").drop("_n")
    return one.join(stored.select("key"), "key", "left_anti").withColumn("status", F.lit("PENDING")).withColumn("attempts", F.lit(0))


def reminders(deadlines: DataFrame, opportunities: DataFrame, dismissed: DataFrame, today: date, catch_up: bool = False) -> DataFrame:
    """Due reminders: active opportunities not dismissed throughout, on a threshold day."""
    horizon = max(max(v) for v in THRESHOLDS.values())
    near = deadlines.where(F.col("due").between(F.lit(today), F.date_add(F.lit(today), horizon)))
    active = opportunities.where(~F.col("status").isin(*TERMINAL)).select("id", "institution", "name")
    hit = near.join(active, "id").join(dismissed.select("id"), "id", "left_anti")
    return hit.withColumn("threshold", fired_threshold(F.col("kind"), F.col("due"), today, catch_up)).where("threshold is not null").withColumn(
        "key", idempotency_key(F.lit("DEADLINE"), F.col("id"), F.col("kind"), F.col("due"), F.col("threshold")))


def alerts(positions: DataFrame, changed: DataFrame, announced: DataFrame) -> DataFrame:
    """(entity, category, subject): new primary positions, then alertable changes of entities that
    this run did not announce, then workloads that became known. Sources of trust 3 and 4 are silent."""
    trusted = positions.where("trust_level <= 2")
    new = trusted.where("primary_alert").join(announced, "entity", "left_anti").select("entity", F.lit("NEW_OPPORTUNITY").alias("category"), F.col("position").alias("subject"))
    fresh = new.select("entity").distinct()
    change = changed.where("alertable").join(trusted.select("entity").distinct(), "entity", "left_semi").join(fresh, "entity", "left_anti").select("entity", F.lit("CHANGE").alias("category"), F.col("field").alias("subject"))
    known = changed.where("field = 'weekly_workload' and raw_old is null and raw_new is not null").join(trusted.select("entity").distinct(), "entity", "left_semi").select(
        "entity", F.lit("WORKLOAD_KNOWN").alias("category"), F.col("field").alias("subject"))
    return new.union(change).union(known).distinct()


def pending(outbox: DataFrame, now: datetime, limit: int = BATCH) -> DataFrame:
    due = F.col("not_before").isNull() | (F.col("not_before") <= F.lit(now))
    return outbox.where(F.col("status").isin("PENDING", "RETRY") & due).orderBy("created_at", "key").limit(limit)


def delivered(rows: DataFrame, now: datetime, hold_uncertain: bool = True) -> DataFrame:
    """Status after an attempt: ``result`` and ``retry_after`` (seconds, may be null) of each row."""
    n = F.col("attempts") + 1
    wait = F.coalesce("retry_after", 60 * n)
    again = (F.col("result") == "RETRY") | ((F.col("result") == "UNCERTAIN") & F.lit(not hold_uncertain))
    status = (F.when(F.col("result") == "SENT", "SENT").when(again & (n < MAX_ATTEMPTS), "RETRY").when(again, "FAILED")
              .when(F.col("result").isin("UNCERTAIN", "BLOCKED", "UNCONFIGURED"), F.col("result")).otherwise("FAILED"))
    return rows.withColumn("new_status", status).withColumn("new_attempts", F.when(F.col("result") == "UNCONFIGURED", F.col("attempts")).otherwise(n)).withColumn(
        "new_not_before", F.when(status == "RETRY", F.lit(now) + F.make_dt_interval(secs=wait.cast("decimal(18,6)"))))


def dismissed_throughout(positions: DataFrame, tracking: DataFrame) -> DataFrame:
    """Opportunities all of whose positions are dismissed; a position without a decision is not."""
    every = F.bool_and(F.coalesce(F.col("tracking_status") == "DISMISSED", F.lit(False)))
    return positions.join(tracking.select("position", F.col("status").alias("tracking_status")), "position", "left").groupBy("id").agg(every.alias("all_dismissed")).where("all_dismissed").select("id")
