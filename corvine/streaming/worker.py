"""The job queue and the trace store on ``transformWithState``: timers bring back what waits, state lives as long as it may.

Time is the events' own, so a queue replays alike; a watermark moves it on.  Whatever clock the caller has, ticks of it keep an idle queue
going.  The state store has to be RocksDB (``settings``).

``jobs``: events (``paper_id, fingerprint, event, at``) by ``queue.step``.  A job that waits for its next try, and one that was claimed and is
silent for ``STALE`` seconds, come back by a timer of their own, not by somebody's next event.  ``traces``: requests (``tenant, user_id,
trace_id, event, data, at``) with event ``put``, ``get`` or ``tick``; the tenant is a part of the key, a trace lives ``TRACE_TTL`` seconds after it was put, and the
``CAPACITY`` traces of a tenant that were used last stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from .queue import step

#: Seconds after which a silent job is pending again, seconds that a trace lives, traces of a tenant.
STALE, TRACE_TTL, CAPACITY = 3600, 1800, 1000

JOBS = "paper_id string, fingerprint string, status string, attempts int, next_retry_at timestamp, reason string, at timestamp"
JOB_STATE = "status string, attempts int, retry long, changed long"
TRACES = "tenant string, user_id string, trace_id string, event string, outcome string, data string, at timestamp"
TRACE_STATE = "user_id string, data string, made long, used long"


def settings(spark: SparkSession) -> None:
    """What a session needs for keyed state with timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def millis(at: pd.Timestamp | None) -> int | None:
    return None if at is None or pd.isna(at) else int(at.value // 1_000_000)


def stamp(ms: int | None) -> pd.Timestamp | None:
    return None if ms is None or ms < 0 else pd.Timestamp(ms, unit="ms")


class JobProcessor(StatefulProcessor):
    """One state a job; a timer while it waits or is worked on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", JOB_STATE)

    def _put(self, status: str, attempts: int, retry: int | None, changed: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.state.update((status, attempts, -1 if retry is None else retry, -1 if changed is None else changed))
        if status == "processing":
            self.handle.registerTimer(changed + STALE * 1000 + 1)
        elif status == "pending" and retry is not None:
            self.handle.registerTimer(retry)

    def _row(self, key: Any, status: str, attempts: int, retry: int | None, reason: str, at: int) -> pd.DataFrame:
        row = {"paper_id": [key[0]], "fingerprint": [key[1]], "status": [status], "attempts": [attempts], "next_retry_at": [stamp(retry)], "reason": [reason], "at": [stamp(at)]}
        return pd.DataFrame(row).astype({"next_retry_at": "datetime64[ns]", "at": "datetime64[ns]", "attempts": "int32"})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        status, attempts, retry, changed = None, 0, None, None
        if self.state.exists():
            status, attempts, retry, changed = self.state.get()
            retry, changed = stamp(retry), stamp(changed)
        before = status
        events = pd.concat(list(rows)).sort_values("at", kind="stable")
        at = None
        for event, at in zip(events["event"], events["at"], strict=True):
            if event != "tick":
                status, attempts, retry, changed = step(status, int(attempts), None if retry is None or pd.isna(retry) else retry, changed, event, at, STALE)
        if status is not None:
            self._put(status, attempts, millis(retry), millis(changed))
            yield self._row(key, status, attempts, millis(retry), "new" if before is None else "event", millis(at))

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        status, attempts, retry, changed = self.state.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if status == "processing":
            self._put("pending", attempts, None, at)
            yield self._row(key, "pending", attempts, None, "stale", at)
        elif status == "pending" and retry >= 0:
            self._put("pending", attempts, None, changed)
            yield self._row(key, "pending", attempts, None, "due", at)


def jobs(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """The states of jobs (``JOBS``) as events or their timers change them; ``reason`` is new, event, stale or due."""
    return events.withWatermark("at", late).groupBy("paper_id", "fingerprint").transformWithStateInPandas(JobProcessor(), JOBS, "Update", "EventTime")


class TraceProcessor(StatefulProcessor):
    """The traces of one tenant, by their ids; each has a timer at the end of its life."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("traces", "trace_id string", TRACE_STATE)
        self.count = handle.getValueState("count", "n int")

    def _row(self, tenant: str, user: str | None, trace: str | None, event: str, outcome: str, data: str | None, at: int) -> dict:
        return {"tenant": tenant, "user_id": user, "trace_id": trace, "event": event, "outcome": outcome, "data": data, "at": stamp(at)}

    def _frame(self, rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in TRACES.split(", ")]).astype({"at": "datetime64[ns]"})

    def _gone(self, tenant: str, trace: str, value: tuple, outcome: str, at: int) -> dict:
        self.held.removeKey((trace,))
        return self._row(tenant, value[0], trace, "evict", outcome, None, at)

    def _expire(self, tenant: str, now: int) -> list[dict]:
        """Takes out what a timer found dead; the map is read for timers and beyond the capacity only."""
        dead = [(k[0], v) for k, v in self.held.iterator() if now - v[2] >= TRACE_TTL * 1000]
        return [self._gone(tenant, trace, v, "expired", v[2] + TRACE_TTL * 1000) for trace, v in dead]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        tenant, out = key[0], []
        n = self.count.get()[0] if self.count.exists() else 0
        for user, trace, event, data, at in pd.concat(list(rows)).sort_values("at", kind="stable")[["user_id", "trace_id", "event", "data", "at"]].itertuples(index=False):
            now = millis(at)
            if event == "tick":
                continue
            known = self.held.getValue((trace,)) if self.held.containsKey((trace,)) else None
            if known is not None and now - known[2] >= TRACE_TTL * 1000:  # dead, though its timer has not come yet
                out.append(self._gone(tenant, trace, known, "expired", known[2] + TRACE_TTL * 1000))
                known, n = None, n - 1
            if known is not None and known[0] != user:
                out.append(self._row(tenant, user, trace, event, "denied", None, now))
            elif event == "put":
                n += known is None
                self.held.updateValue((trace,), (user, data, now, now))
                self.handle.registerTimer(now + TRACE_TTL * 1000)
                out.append(self._row(tenant, user, trace, event, "stored", None, now))
                if n > CAPACITY:
                    used = sorted((v[3], k[0], v) for k, v in self.held.iterator())
                    out += [self._gone(tenant, old, v, "capacity", now) for _, old, v in used[: n - CAPACITY]]
                    n = CAPACITY
            elif event == "get" and known is None:
                out.append(self._row(tenant, user, trace, event, "not_found", None, now))
            elif event == "get":
                self.held.updateValue((trace,), (known[0], known[1], known[2], now))
                out.append(self._row(tenant, user, trace, event, "found", known[1], now))
        self.count.update((n,))
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if out := self._expire(key[0], expiredTimerInfo.getExpiryTimeInMs()):
            self.count.update((self.count.get()[0] - len(out),))
            yield self._frame(out)


def traces(requests: DataFrame, late: str = "0 seconds") -> DataFrame:
    """What became of each request, and evictions (``TRACES``)."""
    return requests.withWatermark("at", late).groupBy("tenant").transformWithStateInPandas(TraceProcessor(), TRACES, "Update", "EventTime")
