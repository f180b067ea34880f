"""The job queue and the trace store with timers, on the events' own clock."""

from __future__ import annotations

import datetime as dt

import pytest

from corvine.streaming import worker

START = dt.datetime(2024, 1, 1)
JOB = "paper_id string, fingerprint string, event string, at timestamp"
REQUEST = "tenant string, user_id string, trace_id string, event string, data string, at timestamp"


@pytest.fixture(scope="module")
def played(spark, tmp_path_factory):
    """Runs batches of rows through a stream, one file a batch, and gives all that came out."""

    def play(make, schema, batches):
        worker.settings(spark)
        few = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        folder = tmp_path_factory.mktemp("stream")
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / "in" / f"{n:03d}"))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(folder / "in"))
        out = []
        query = make(source).writeStream.foreachBatch(lambda frame, n: out.extend(frame.collect())).outputMode("update").option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.conf.set("spark.sql.shuffle.partitions", few)
        assert query.exception() is None
        return out

    return play


def at(seconds: float) -> dt.datetime:
    return START + dt.timedelta(seconds=seconds)


def test_jobs_come_back_by_timers(played):
    event = lambda paper, name, s: (paper, "f", name, at(s))
    tick = lambda s: ("clock", "", "tick", at(s))
    batches = [
        [event("a", "enqueue", 0), event("b", "enqueue", 0), event("c", "enqueue", 0)],
        [event("a", "claim", 10), event("b", "claim", 10), event("c", "claim", 10)],
        [event("b", "fail", 20), event("c", "done", 20), event("c", "enqueue", 21)],
        [tick(90)], [tick(3700)], [tick(3800)], [event("a", "claim", 3900)], [tick(8000)], [tick(8100)],
    ]
    out = played(worker.jobs, JOB, batches)
    story = lambda paper: [(r["status"], r["attempts"], r["reason"], (r["at"] - START).total_seconds()) for r in out if r["paper_id"] == paper]
    assert story("a") == [("pending", 0, "new", 0), ("processing", 0, "event", 10), ("pending", 0, "stale", 3610.001), ("processing", 0, "event", 3900), ("pending", 0, "stale", 7500.001)]
    assert story("b") == [("pending", 0, "new", 0), ("processing", 0, "event", 10), ("pending", 1, "event", 20), ("pending", 1, "due", 80)]
    assert story("c") == [("pending", 0, "new", 0), ("processing", 0, "event", 10), ("done", 0, "event", 21)] and not story("clock")


def test_traces_belong_to_tenant_and_user_and_die(played, monkeypatch):
    ask = lambda tenant, user, trace, event, s, data=None: (tenant, user, trace, event, data, at(s))
    batches = [
        [ask("t", "u", "x", "put", 0, "one"), ask("t", "u", "y", "put", 5, "two")],
        [ask("t", "u", "x", "get", 10), ask("t", "v", "x", "get", 11), ask("s", "u", "x", "get", 12), ask("t", "v", "x", "put", 13, "stolen")],
        [ask("s", None, None, "tick", 1790)], [ask("t", "u", "x", "get", 1799)], [ask("s", None, None, "tick", 1900)], [ask("s", None, None, "tick", 1901)], [ask("t", "u", "x", "get", 1902)],
    ]
    out = [(r["tenant"], r["user_id"], r["trace_id"], r["event"], r["outcome"], r["data"]) for r in played(worker.traces, REQUEST, batches)]
    assert out[:2] == [("t", "u", "x", "put", "stored", None), ("t", "u", "y", "put", "stored", None)]
    assert set(out[2:6]) == {("t", "u", "x", "get", "found", "one"), ("t", "v", "x", "get", "denied", None), ("s", "u", "x", "get", "not_found", None), ("t", "v", "x", "put", "denied", None)}
    assert out[6] == ("t", "u", "x", "get", "found", "one")
    assert sorted(out[7:9]) == [("t", "u", "x", "evict", "expired", None), ("t", "u", "y", "evict", "expired", None)] and out[9:] == [("t", "u", "x", "get", "not_found", None)]


def test_the_least_used_traces_go_first(played):
    n = worker.CAPACITY
    first = [("t", "u", f"{i:05d}", "put", "d", at(i / 1000)) for i in range(n)]
    out = played(worker.traces, REQUEST, [first, [("t", "u", "00000", "get", None, at(20)), ("t", "u", "new", "put", "d", at(21))]])
    assert [(r["trace_id"], r["outcome"]) for r in out if r["event"] == "evict"] == [("00001", "capacity")]
