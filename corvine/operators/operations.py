"""Operational analytics: job queues, retention, windows of events, histograms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of back-off by attempt, and attempts after which a job fails.
BACKOFF, MOST_ATTEMPTS = (60, 600, 3600), 3
#: Upper edges of latency buckets.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def status_counts(jobs: DataFrame, domain: Sequence[str]) -> DataFrame:
    """``status, n`` with zeros for statuses without jobs."""
    all_ = jobs.sparkSession.createDataFrame([(s,) for s in domain], "status string")
    return all_.join(jobs.groupBy("status").agg(F.count("*").alias("n")), "status", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def claim(jobs: DataFrame, now: Column, limit: int) -> DataFrame:
    """The jobs a worker takes: of the first ``2 * limit`` pending ones by id those that are due, ``limit`` at most."""
    read = jobs.where("status = 'pending'").orderBy("id").limit(2 * limit)
    return read.where(F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)).orderBy("id").limit(limit)


def after_failure(jobs: DataFrame, now: Column) -> DataFrame:
    """Status, attempts and next try of jobs that have just failed."""
    attempts = F.col("attempts") + 1
    wait = F.get(F.array(*map(F.lit, BACKOFF)), F.least(attempts - 1, F.lit(len(BACKOFF) - 1)))
    failed = attempts >= MOST_ATTEMPTS
    return jobs.withColumns({"status": F.when(failed, "failed").otherwise("pending"), "next_retry_at": F.when(~failed, F.timestamp_add("SECOND", wait, now)), "attempts": attempts})


def requeue_stale(jobs: DataFrame, now: Column, seconds: int = 3600) -> DataFrame:
    stale = (F.col("status") == "processing") & (F.col("updated_at") < F.timestamp_add("SECOND", F.lit(-seconds), now))
    return jobs.withColumn("status", F.when(stale, "pending").otherwise(F.col("status")))


def retained(entries: DataFrame, now: Column, ttl: int, capacity: int) -> DataFrame:
    """Entries that neither their age nor the capacity has evicted, the last used first."""
    live = entries.where(F.timestamp_add("SECOND", F.lit(ttl), F.col("created_at")) > now)
    return live.orderBy(F.desc("last_access"), "key").limit(capacity)


def first_in_window(items: DataFrame, by: Sequence[str], at: str, seconds: float, order: str, blocks: str | None = None) -> DataFrame:
    """Items that come more than ``seconds`` after the last item of their kind that was kept; those without a time are kept.

    ``blocks`` names a boolean column: kept items where it is not true (reviews that are settled) hold back no later ones.

    Whether an item stays depends on all before it, so a kind's items stream through one task in order of
    time, which holds no more than the last kept time of the kind at hand.
    """
    names, kinds = items.columns, items.schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = kept = None
        for batch in batches:
            own = []
            for *key, live, micros in zip(*(c.to_pylist() for c in batch.columns[len(names) :]), strict=True):
                kind, kept = key, (kept if key == kind else None)
                stays = micros is None or kept is None or micros > kept + seconds * 1_000_000
                kept = micros if stays and live and micros is not None else kept
                own.append(stays)
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names).filter(pa.array(own, pa.bool_()))

    keyed = items.select("*", *[F.col(c).alias(f"by_{i}") for i, c in enumerate(by)], (F.lit(True) if blocks is None else F.col(blocks)).alias("live"), F.unix_micros(F.col(at).cast("timestamp")).alias("micros"))
    columns = [f"by_{i}" for i in range(len(by))]
    return keyed.repartition(*columns).sortWithinPartitions(*columns, "micros", order).mapInArrow(fold, kinds)


def histogram(values: DataFrame, value: str, by: str, edges: Sequence[float] = BUCKETS) -> DataFrame:
    """Cumulative counts by bucket edge, the last without bound: one pass, as many counters as edges."""
    counts = [F.count_if(F.col(value) <= e).alias(f"b{i}") for i, e in enumerate(edges)]
    wide = values.groupBy(by).agg(*counts, F.count(value).alias("all"))
    pairs = [F.struct(F.lit(str(e)).alias("le"), F.col(f"b{i}").alias("n")) for i, e in enumerate(edges)]
    return wide.select(by, F.inline(F.array(*pairs, F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))))


def consumption(entries: DataFrame) -> DataFrame:
    """One row a paper: the papers named, else the entry's own, else one without paper."""
    return entries.select("entry_id", F.explode_outer(F.when(F.size("explicit") > 0, F.col("explicit")).otherwise(F.col("key_papers"))).alias("paper_id"))


def outbox(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """Entries whose mirror is behind: never mirrored, or at another version; oldest change first, ``limit`` a round.

    ``entries`` has ``entry_id, version, mirrored_version, updated_at``.  An entry leaves when its mirrored version is written back.
    """
    dirty = entries.where(~F.col("version").eqNullSafe(F.col("mirrored_version"))).orderBy("updated_at", "entry_id")
    return dirty if limit is None else dirty.limit(limit)


def stop_reason(found: Column, sufficiency: Column, follow_up: Column, last: Column) -> Column:
    """Why a question's rounds end with this one: no_evidence or answered; null if its follow-up is asked next."""
    asks = (F.coalesce(sufficiency, F.lit("")) != "sufficient") & (F.trim(F.coalesce(follow_up, F.lit(""))) != "")
    return F.when(found == 0, "no_evidence").when(asks & ~last, F.lit(None)).otherwise("answered")


def ended(rounds: DataFrame, most: int = 3) -> DataFrame:
    """``query_id, rounds, stopped_by`` of logged rounds (``query_id, round, found, sufficiency, follow_up``); without an end, max_iters."""
    reason = stop_reason(F.col("found"), F.col("sufficiency"), F.col("follow_up"), F.col("round") >= most - 1)
    known = rounds.where(F.col("round") < most).withColumn("reason", reason)
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct("round", "reason")))
    return known.groupBy("query_id").agg(first.alias("e"), F.max("round").alias("seen")).select(
        "query_id", (F.coalesce("e.round", "seen") + 1).alias("rounds"), F.coalesce("e.reason", F.lit("max_iters")).alias("stopped_by")
    )
