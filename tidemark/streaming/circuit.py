"""Source health as keyed state with timers, over a stream of attempts in any order within the lateness.

The same rules as :func:`tidemark.operators.health.timeline`, one source at a time: attempts wait in list state
until the watermark has passed them, are then judged in order of time, and leave a row each. A second list
holds the last 20 successful counts for drift. An open circuit sets a timer for the end of its cooldown; where it fires
before a healthy attempt, the source is RECOVERING, which is a row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tidemark.operators.health import COOLDOWN_HOURS, FAILURES, HISTORY

ROWS = "source_id string, kind string, at timestamp, seq long, streak int, drift string, state string, open_until timestamp, alert boolean"
SETTING = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MICRO = timedelta(microseconds=1)
_ZERO = datetime(1970, 1, 1, tzinfo=timezone.utc)


def drift(found: int | None, history: list[int], expected_min: int | None, status: int | None) -> str | None:
    """Why a thin result looks like a changed page."""
    if found is None or status is not None and status >= 400:
        return None
    usable = sorted(v for v in history if v > 0)
    n = len(usable)
    median = (usable[(n - 1) // 2] + usable[n // 2]) / 2 if n else 0
    if found == 0 and (expected_min or 0) > 0:
        return "below_minimum"
    if found == 0 and n:
        return "zero_after_history"
    return "sharp_drop" if n >= 3 and median >= 4 and found < median * 0.25 else None


class Circuit(StatefulProcessor):
    """State: ``now`` (streak, state, end of the cooldown in microseconds, whether it was announced), ``counts``
    and ``waiting``; times are microseconds, so their order is exact."""

    def __init__(self, failures: int = FAILURES, cooldown_hours: int = COOLDOWN_HOURS) -> None:
        self.failures, self.cooldown = failures, cooldown_hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "streak int, state string, until long, announced boolean")
        self.counts = handle.getListState("counts", "found int")
        self.waiting = handle.getListState("waiting", "at long, seq long, success boolean, found int, status int, expected_min int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = []
        for f in rows:
            at = pd.to_datetime(f["at"], utc=True)
            for t, *r in zip(at, f["seq"], f["success"], f["found"], f["status"], f["expected_min"]):
                seq, success, *numbers = r
                new.append(((t.to_pydatetime() - _ZERO) // _MICRO, int(seq), bool(success), *[None if pd.isna(x) else int(x) for x in numbers]))
        if new:
            self.waiting.appendList(new)
            self._wake()
        yield pd.DataFrame(columns=[c.split()[0] for c in ROWS.split(", ")])

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in held if r[0] <= passed]
        streak, state, until, announced = self.now.get() if self.now.exists() else (0, None, None, True)
        counts = [r[0] for r in self.counts.get()] if self.counts.exists() else []
        out = []

        def recover(moment: int) -> None:
            nonlocal announced
            if state == "OPEN" and not announced and until <= moment:
                out.append((key[0], "recovery", until, None, streak, None, "RECOVERING", until, False))
                announced = True

        for at, seq, success, found, status, expected in due:
            recover(at)
            why = drift(found, counts, expected, status)
            streak = 0 if success else streak + 1
            was, state = state, ("HEALTHY" if why is None else "DEGRADED") if success else "OPEN" if streak >= self.failures else "DEGRADED"
            if state == "HEALTHY":
                until = None
            elif state == "OPEN":
                until, announced = at + self.cooldown, False
            alert = state == "OPEN" and was != "OPEN" or state == "DEGRADED" and success and was != "DEGRADED"
            out.append((key[0], "attempt", at, seq, streak, why, state, until, alert))
            if success and found is not None:
                counts = [*counts, found][-HISTORY:]
        recover(passed)
        if due or out:
            self.now.update((streak, state, until, announced))
            left = held[len(due):]
            self.waiting.put(left) if left else self.waiting.clear()
            self.counts.put([(c,) for c in counts]) if counts else self.counts.clear()
        self._wake()
        made = pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])
        for c in ("at", "open_until"):
            made[c] = pd.to_datetime(made[c].astype("Int64"), unit="us")
        yield made.astype({"seq": "Int64", "streak": "Int32"})

    def _wake(self) -> None:
        """One timer: for the earliest attempt that waits, or the end of the cooldown."""
        times = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        if self.now.exists():
            _, state, until, announced = self.now.get()
            times += [until] if state == "OPEN" and not announced else []
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if times:
            self.handle.registerTimer(-(-min(times) // 1000))

    def close(self) -> None:
        """Nothing is held open."""


def circuit(attempts: DataFrame, late: str = "1 hour", failures: int = FAILURES, cooldown_hours: int = COOLDOWN_HOURS) -> DataFrame:
    """Rows of kind 'attempt' (as the batch timeline has them) and 'recovery' from a stream of attempts (source_id, at,
    seq, success, found, status, expected_min). Attempts more than ``late`` behind the latest are dropped."""
    if attempts.sparkSession.conf.get(SETTING) != PROVIDER:
        raise RuntimeError(f"keyed state with timers needs {SETTING} = {PROVIDER}")
    rows = attempts.select("source_id", "at", "seq", "success", "found", "status", "expected_min").withWatermark("at", late)
    return rows.groupBy("source_id").transformWithStateInPandas(Circuit(failures, cooldown_hours), ROWS, "Append", "EventTime")
