"""Source health: drift, failure streaks, circuit breaker, run status and the watchdog."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import idempotency_key

HISTORY, FAILURES, COOLDOWN_HOURS, SILENCE_HOURS = 20, 3, 6, 30


def drift(found: Column, history: Column, expected_min: Column, status: Column, structure_changed: Column) -> Column:
    """The reason why a thin result looks like a changed page; null if it does not.

    ``history`` is the array of earlier counts. An HTTP failure is never drift.
    """
    usable = F.filter(history, lambda v: v > 0)
    n = F.size(usable)
    s = F.array_sort(usable)
    median = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0
    return (F.when(F.coalesce(status >= 400, F.lit(False)), None)
            .when((found == 0) & (expected_min > 0), "below_minimum").when((found == 0) & (n > 0), "zero_after_history")
            .when((n >= 3) & (median >= 4) & (found < median * 0.25), "sharp_drop")
            .when(structure_changed & (found == 0), "structure_changed"))


def upper_median(values: Column) -> Column:
    """The upper of the middle two."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def timeline(attempts: DataFrame, failures: int = FAILURES, cooldown_hours: int = COOLDOWN_HOURS) -> DataFrame:
    """Health after each attempt (source_id, at, seq, success, found, expected_min, status).

    Streaks are islands between successes; state follows from the streak and drift alone; the
    circuit's end is carried from the last opening until a healthy attempt clears it.
    """
    w = Window.partitionBy("source_id").orderBy("at", "seq")
    rows = attempts.withColumn("island", F.sum(F.col("success").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # the last HISTORY successful counts before this attempt: built on successes alone, carried over failures
    rows = rows.withColumn("counted", F.coalesce(F.col("success") & F.col("found").isNotNull(), F.lit(False)))
    counts = F.collect_list("found").over(Window.partitionBy("source_id", "counted").orderBy("at", "seq").rowsBetween(1 - HISTORY, 0))
    rows = rows.withColumn("counts", F.when(F.col("counted"), counts))
    before = F.last("counts", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("history", F.coalesce(before, F.array().cast(rows.schema["counts"].dataType)))
    streak = F.when(F.col("success"), 0).otherwise(
        F.row_number().over(Window.partitionBy("source_id", "island").orderBy("at", "seq")) - F.when(F.col("island") > 0, 1).otherwise(0))
    rows = rows.withColumn("streak", streak).withColumn("drift", drift(F.col("found"), F.col("history"), F.col("expected_min"), F.col("status"), F.lit(False)))
    state = (F.when(F.col("success") & F.col("drift").isNull(), "HEALTHY").when(F.col("success"), "DEGRADED")
             .when(F.col("streak") >= failures, "OPEN").otherwise("DEGRADED"))
    rows = rows.withColumn("state", state).withColumn("healthy_n", F.sum((F.col("state") == "HEALTHY").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    era = Window.partitionBy("source_id", "healthy_n").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.last(F.when(F.col("state") == "OPEN", F.col("at")), ignorenulls=True).over(era)
    before = F.lag("state").over(w)
    return rows.withColumn("open_until", opened + F.expr(f"interval {cooldown_hours} hours")).withColumn(
        "alert", F.coalesce((F.col("state") == "OPEN") & (before != "OPEN") | (F.col("state") == "DEGRADED") & F.col("success") & (before != "DEGRADED"), F.lit(True)) & (F.col("state") != "HEALTHY")
    ).drop("island", "healthy_n", "counted", "counts")


def latest(line: DataFrame) -> DataFrame:
    w = Window.partitionBy("source_id").orderBy(F.desc("at"), F.desc("seq"))
    return line.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def current(attempts: DataFrame, failures: int = FAILURES) -> DataFrame:
    """(source_id, state): the states of :func:`latest` over :func:`timeline`, from the last few attempts of each source. A
    state looks back on ``failures`` attempts and HISTORY successful counts, so no task orders all attempts of a source."""
    order = Window.partitionBy("source_id").orderBy(F.desc("at"), F.desc("seq"))
    first = lambda rows, n: rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
    ended = ~F.coalesce("success", F.lit(False))
    tried = first(attempts.select("source_id", "at", "seq", "success", "found", "expected_min", "status"), failures)
    last = tried.groupBy("source_id").agg(F.min_by(F.struct("at", "seq", "success", "found", "expected_min", "status"), "_n").alias("l"), F.count_if(ended).alias("failed"))
    good = first(attempts.where("success and found is not null").select("source_id", "at", "seq", "found"), HISTORY + 1)
    good = good.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("_n", "at", "seq", "found"))).alias("good"))
    x, l = F.col("good"), F.col("l")
    before = F.slice(F.filter(F.coalesce(x, F.array().cast(good.schema["good"].dataType)), lambda g: (g["at"] != l["at"]) | (g["seq"] != l["seq"])), 1, HISTORY)
    reason = drift(l["found"], F.transform(before, lambda g: g["found"]), l["expected_min"], l["status"], F.lit(False))
    state = (F.when(l["success"] & reason.isNull(), "HEALTHY").when(l["success"], "DEGRADED").when(F.col("failed") >= failures, "OPEN").otherwise("DEGRADED"))
    return last.join(good, "source_id", "left").select("source_id", state.alias("state"))


def next_state(current: Column, success: Column, streak: Column, drifted: Column, failures: int = FAILURES) -> Column:
    """The state after an attempt; only a person ends DISABLED."""
    return (F.when(current == "DISABLED", "DISABLED").when(success & ~drifted, "HEALTHY").when(success, "DEGRADED")
            .when(streak >= failures, "OPEN").otherwise("DEGRADED"))


def standing(line: DataFrame, sources: DataFrame, now: datetime) -> DataFrame:
    """(source_id, state, skip) of all sources (id, enabled) at ``now``: disabled ones are DISABLED, an open
    circuit whose end has passed is RECOVERING and is tried, a source without attempts is HEALTHY."""
    last = latest(line).select("source_id", "state", "open_until")
    both = sources.select(F.col("id").alias("source_id"), "enabled").join(last, "source_id", "left")
    t = F.lit(now)
    state = (F.when(~F.col("enabled"), "DISABLED").when(entering_recovery(F.col("state"), F.col("open_until"), t), "RECOVERING")
             .otherwise(F.coalesce("state", F.lit("HEALTHY"))))
    return both.select("source_id", state.alias("state"), should_skip(state, F.col("open_until"), t).alias("skip"))


def source_runs(attempts: DataFrame) -> DataFrame:
    """One row a source and day: attempts, successes, failures, documents found and the run's status."""
    each = attempts.groupBy("source_id", "day").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures"), F.sum("found").alias("documents"))
    return each.withColumn("status", run_status(F.col("attempts"), F.lit(0), F.col("successes"), F.col("failures")))


def notices(verdict: DataFrame, now: datetime) -> DataFrame:
    """(key, severity, problems) of a watchdog's row if it is to be told: a critical one every day, a warning
    whenever its problems change, nothing if all is well."""
    found = F.array_compact(F.array(
        F.when(F.col("open_sources") > 0, F.concat(F.col("open_sources").cast("string"), F.lit(" fonte(s) com circuito aberto ou desativadas"))),
        F.when(F.col("failed_messages") > 0, F.concat(F.col("failed_messages").cast("string"), F.lit(" notificação(ões) pendentes de entrega ou revisão")))))
    rows = verdict.where("severity <> 'OK'").withColumn("problems", F.array_sort(found))
    scope = F.when(F.col("severity") == "CRITICAL", F.lit(now.date().isoformat())).otherwise(F.sha2(F.array_join("problems", "\n"), 256))
    return rows.select(idempotency_key(F.lit("SYSTEM"), F.lit("watchdog"), F.col("severity"), scope).alias("key"), "severity", "problems")


def should_skip(state: Column, open_until: Column, now: Column) -> Column:
    return (state == "DISABLED") | F.coalesce((state == "OPEN") & (now < open_until), F.lit(False))


def entering_recovery(state: Column, open_until: Column, now: Column) -> Column:
    return F.coalesce((state == "OPEN") & (now >= open_until), F.lit(False))


def rate(successes: Column, attempts: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(successes, attempts), F.lit(0.0)), 3)


def histogram(states: DataFrame) -> DataFrame:
    """One row: sources by state."""
    return states.agg(*[F.count_if(F.col("state") == s).alias(s.lower()) for s in ("HEALTHY", "DEGRADED", "OPEN", "RECOVERING", "DISABLED")])


def run_status(attempted: Column, skipped: Column, successes: Column, errors: Column) -> Column:
    return (F.when((attempted > 0) & (skipped == attempted), "SKIPPED").when((attempted - skipped > 0) & (successes == 0), "FAILED")
            .when((errors > 0) | (successes < attempted - skipped), "PARTIAL").otherwise("SUCCESS"))


def freshness(started: Column, attempted: Column, successes: Column, now: datetime) -> Column:
    """MISSING, STALE, PARTIAL or SUCCESS of the latest run."""
    enough = successes >= F.greatest(F.lit(1), F.floor(attempted / 2))
    return F.when(started.isNull(), "MISSING").when(F.to_date(started) != F.to_date(F.lit(now)), "STALE").when(enough, "SUCCESS").otherwise("PARTIAL")


def watchdog(runs: DataFrame, states: DataFrame, outbox: DataFrame, now: datetime) -> DataFrame:
    """One row: severity, hours of silence and the counters it follows from."""
    last = runs.where(F.col("status").isin("SUCCESS", "PARTIAL")).agg(F.max("started_at").alias("last_success"))
    bad = states.agg(F.count_if(F.col("state").isin("OPEN", "DISABLED")).alias("open_sources"), F.count_if(F.col("state") == "DEGRADED").alias("degraded_sources"))
    held = outbox.agg(F.count_if(F.col("status").isin("FAILED", "UNCERTAIN")).alias("failed_messages"), F.count_if(F.col("status") == "PENDING").alias("pending_messages"))
    hours = F.floor((F.unix_timestamp(F.lit(now)) - F.unix_timestamp("last_success")) / 3600).cast("long")
    return last.crossJoin(bad).crossJoin(held).withColumn("silent_hours", hours).withColumn(
        "severity", F.when(F.col("last_success").isNull() | (F.col("silent_hours") > SILENCE_HOURS), "CRITICAL")
        .when((F.col("open_sources") > 0) | (F.col("failed_messages") > 0), "WARNING").otherwise("OK"))
