"""A durable job queue on keyed state: claims, back-off, failure, and recovery of stale jobs.

Events ``(paper_id, fingerprint, event, at)`` with event ``enqueue``, ``claim``, ``done`` or ``fail``
drive one state a job.  Enqueueing a known job changes nothing; a failed job waits by the back-off
table and fails for good after the last attempt; a claimed job that is silent too long is pending again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.operations import BACKOFF, MOST_ATTEMPTS

OUTPUT = "paper_id string, fingerprint string, status string, attempts int, next_retry_at timestamp"
STATE = "status string, attempts int, next_retry_at timestamp, changed_at timestamp"


def step(status: str | None, attempts: int, retry: pd.Timestamp | None, changed: pd.Timestamp | None, event: str, at: pd.Timestamp, stale: int = 3600) -> tuple:
    """The state of a job after one event."""
    if status == "processing" and changed is not None and at - changed > pd.Timedelta(seconds=stale):
        status = "pending"
    if event == "enqueue":
        return (status or "pending", attempts, retry, changed or at)
    if event == "claim" and status == "pending" and (retry is None or retry <= at):
        return ("processing", attempts, None, at)
    if event == "done" and status == "processing":
        return ("done", attempts, None, at)
    if event == "fail" and status == "processing":
        attempts += 1
        if attempts >= MOST_ATTEMPTS:
            return ("failed", attempts, None, at)
        return ("pending", attempts, at + pd.Timedelta(seconds=BACKOFF[min(attempts - 1, len(BACKOFF) - 1)]), at)
    return (status, attempts, retry, changed)


def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, attempts, retry, changed = state.get if state.exists else (None, 0, None, None)
    rows = pd.concat(list(frames)).sort_values("at", kind="stable")
    for event, at in zip(rows["event"], rows["at"], strict=True):
        status, attempts, retry, changed = step(status, int(attempts), None if pd.isna(retry) else retry, changed, event, at)
    state.update((status, attempts, retry, changed))
    yield pd.DataFrame({"paper_id": [key[0]], "fingerprint": [key[1]], "status": [status], "attempts": [attempts], "next_retry_at": [retry]}).astype({"next_retry_at": "datetime64[ns]"})


def queue(events: DataFrame) -> DataFrame:
    """The states of the jobs that a micro-batch touches."""
    return events.groupBy("paper_id", "fingerprint").applyInPandasWithState(run, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
