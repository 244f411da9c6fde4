"""Delivery of messages over HTTP, row by row on the executors, with the outcome as a column.

A post cannot be taken back, so a message is never sent twice by a task that Spark runs again: rows of a second
attempt of a task are UNCERTAIN without a request, as the first may have sent them. What the service said is
read from the response alone; an address holds a secret and is in no error.
"""

from __future__ import annotations

import http.client
import json
from collections.abc import Iterator
from datetime import datetime
from urllib.parse import urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import outbox
from tidemark.sources.store import staged

#: Units of UTF-16 a message may have, and seconds a service may ask to wait.
UNITS, LONGEST_WAIT, DEFAULT_WAIT, SECONDS = 4096, 86_400, 60, 20.0
OUTCOME = "key string, result string, retry_after long, external_id string, error string"


def judged(status: int, body: object) -> tuple[str, int | None, str | None, str | None]:
    """(result, retry_after, external_id, error) of a response."""
    if not isinstance(body, dict):
        return "UNCERTAIN", None, None, "the response is no object"
    code, details = body.get("error_code"), body.get("parameters")
    if 429 in (status, code):
        asked = details.get("retry_after", DEFAULT_WAIT) if isinstance(details, dict) else DEFAULT_WAIT
        return "RETRY", max(1, min(asked, LONGEST_WAIT)) if type(asked) is int else DEFAULT_WAIT, None, "too many requests"
    if status in (400, 401, 403) or code in (400, 401, 403):
        return "BLOCKED", None, None, "the message or its sender was rejected"
    if status >= 500:
        return "UNCERTAIN", None, None, "the service failed after it had the message"
    made = body.get("result")
    if body.get("ok") is True and isinstance(made, dict) and made.get("message_id"):
        return "SENT", None, str(made["message_id"]), None
    return "UNCERTAIN", None, None, "the message was not confirmed"


def post(url: str, chat: str, key: str, body: str, seconds: float = SECONDS) -> tuple[str, int | None, str | None, str | None]:
    """One message, one request. Before a connection stands nothing was sent (RETRY); after that a silence says
    nothing (UNCERTAIN)."""
    if len(body.encode("utf-16-le")) // 2 > UNITS:
        return "BLOCKED", None, None, "the message is too long"
    at = urlparse(url)
    kind = {"https": http.client.HTTPSConnection, "http": http.client.HTTPConnection}.get(at.scheme)
    if not (kind and at.hostname and chat):
        return "UNCONFIGURED", None, None, "no address or chat"
    line = kind(at.hostname, at.port, timeout=seconds)
    try:
        line.connect()
    except OSError:
        return "RETRY", None, None, "no connection"
    try:
        said = json.dumps({"chat_id": chat, "text": body, "disable_web_page_preview": True})
        line.request("POST", f"{at.path}/sendMessage", said.encode(), {"Content-Type": "application/json", "Idempotency-Key": key})
        answer = line.getresponse()
        try:
            return judged(answer.status, json.loads(answer.read()))
        except ValueError:
            return "UNCERTAIN", None, None, "the response cannot be read"
    except (OSError, http.client.HTTPException):
        return "UNCERTAIN", None, None, "no acknowledgment"
    finally:
        line.close()


def attempt(messages: DataFrame, url: str, chat: str) -> DataFrame:
    """(key, result, retry_after, external_id, error) of messages (key, body), each tried once, written before anything
    reads it: no later job sends again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        again = context is not None and context.attemptNumber() > 0
        for batch in batches:
            rows = [(k, *(("UNCERTAIN", None, None, "an earlier attempt may have sent it") if again else post(url, chat, k, b or ""))) for k, b in zip(*(c.to_pylist() for c in batch.columns))]
            types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[c.split()[0] for c in OUTCOME.split(", ")])

    return staged(messages.select("key", "body").mapInArrow(run, OUTCOME))


def deliver(rows: DataFrame, url: str, chat: str, now: datetime, hold_uncertain: bool = True, limit: int = outbox.BATCH) -> DataFrame:
    """The outbox (key, body, status, attempts, not_before, created_at, ...) after one round: due rows are tried in order of
    age, ``limit`` of them; the others are as they were."""
    due = staged(outbox.pending(rows, now, limit))
    # one task a connection, and the order of age within it
    said = attempt(due.orderBy("created_at", "key").coalesce(1), url, chat)
    after = outbox.delivered(due.join(said, "key"), now, hold_uncertain).select(
        "key", F.col("new_status").alias("_s"), F.col("new_attempts").alias("_a"), F.col("new_not_before").alias("_n"), "external_id", "error")
    tried = F.col("_s").isNotNull()
    rest = [c for c in rows.columns if c not in ("status", "attempts", "not_before", "external_id", "error")]
    return rows.drop("external_id", "error").join(after, "key", "left").select(
        *rest, F.coalesce("_s", "status").alias("status"), F.when(tried, F.col("_a")).otherwise(F.col("attempts")).alias("attempts"),
        F.when(tried, F.col("_n")).otherwise(F.col("not_before")).alias("not_before"), "external_id", "error")
