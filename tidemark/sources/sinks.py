"""Sinks: idempotent message files, Markdown reports, heartbeat payloads and event logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deliver(messages: DataFrame, target: str) -> DataFrame:
    """Writes messages (key, body) that the target does not hold yet; returns those written. A replay
    writes nothing, as a message's identity is the digest of its key."""
    spark = messages.sparkSession
    rows = messages.select(F.sha2("key", 256).alias("digest"), "key", "body").dropDuplicates(["digest"])
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        rows = rows.join(spark.read.parquet(target).select("digest"), "digest", "left_anti")
    rows = rows.persist()
    rows.write.mode("append").parquet(target)
    return rows


def markdown(sections: DataFrame, title: str) -> str:
    """The text of a report from its bounded lines (section, line, text)."""
    rows = sections.orderBy("section", "line").collect()  # 25 lines a section at most
    out, last = [f"# {title}"], None
    for r in rows:
        if r.section != last:
            out += ["", f"## {r.section}", ""]
            last = r.section
        out.append(r.text)
    return "\n".join(out) + "\n"


def heartbeat(watchdog: DataFrame, now: datetime) -> DataFrame:
    """A JSON payload for an outside monitor."""
    return watchdog.select(F.to_json(F.struct("severity", "open_sources", "failed_messages", F.lit(now.isoformat()).alias("at")), {"ignoreNullFields": "false"}).alias("payload"))


def logged(rows: DataFrame, level: Column, message: Column, at: datetime, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of an event log: masked messages of 2000 characters at most, beside the columns in ``keep``."""
    from tidemark.functions.text import redact

    return rows.select(*keep, F.lit(at).alias("created_at"), level.alias("level"), F.substring(redact(message), 1, 2000).alias("message"))
