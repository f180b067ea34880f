"""Queries over operational logs: queues, retention, windows, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import operations as O
from ..tables import load
from .registry import registry

QUERIES, SQL, query = registry()

NOW = "2024-01-20 00:00:00"
JOBS = f"""jobs AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'done' ELSE 'failed' END AS status, (event_id % 3)::INT AS attempts, ts AS updated_at, CASE WHEN event_id % 8 = 0 THEN ts END AS next_retry_at, TIMESTAMP '{NOW}' AS now FROM events)"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _now():
    return F.lit(NOW).cast("timestamp")


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    status = F.get(F.array(*map(F.lit, ("pending", "processing", "done", "failed"))), (F.col("event_id") % 4).cast("int"))
    return _events(spark, d).select(F.col("event_id").alias("id"), status.alias("status"), (F.col("event_id") % 3).cast("int").alias("attempts"), F.col("ts").alias("updated_at"), F.when(F.col("event_id") % 8 == 0, F.col("ts")).alias("next_retry_at"))


@query("""WITH e AS (SELECT event_type, value / 50 AS v FROM events), b AS (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0])::DOUBLE AS le)
SELECT event_type, le::VARCHAR AS le, count(*) FILTER (v <= b.le) AS n FROM e, b GROUP BY ALL UNION ALL SELECT event_type, '+Inf', count(v) FROM e GROUP BY 1""")
def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    return O.histogram(_events(spark, d).select("event_type", (F.col("value") / 50).alias("v")), "v", "event_type")


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1) SELECT event_type, v[least(len(v), floor(0.5 * len(v))::INT + 1)] AS p50, v[least(len(v), floor(0.95 * len(v))::INT + 1)] AS p95, v[least(len(v), floor(0.99 * len(v))::INT + 1)] AS p99 FROM s""")
def index_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return E.index_quantiles(_events(spark, d), "event_type", "value", (0.5, 0.95, 0.99))


@query(f"WITH {JOBS} SELECT s.status, count(id) AS n FROM (SELECT unnest(['pending', 'processing', 'done', 'failed', 'skipped']) AS status) s LEFT JOIN jobs USING (status) GROUP BY 1")
def queue_stats(spark: SparkSession, d: str) -> DataFrame:
    return O.status_counts(_jobs(spark, d), ("pending", "processing", "done", "failed", "skipped"))


@query(f"WITH {JOBS}, r AS (SELECT * FROM jobs WHERE status = 'pending' ORDER BY id LIMIT 40) SELECT id FROM r WHERE next_retry_at IS NULL OR next_retry_at <= now ORDER BY id LIMIT 20")
def job_claim(spark: SparkSession, d: str) -> DataFrame:
    return O.claim(_jobs(spark, d), _now(), 20).select("id")


@query(f"WITH {JOBS} SELECT id, attempts + 1 AS attempts, CASE WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN attempts + 1 < 3 THEN CASE attempts WHEN 0 THEN 60 WHEN 1 THEN 600 ELSE 3600 END END::BIGINT AS wait FROM jobs WHERE status = 'processing'")
def retry_schedule(spark: SparkSession, d: str) -> DataFrame:
    failed = O.after_failure(_jobs(spark, d).where("status = 'processing'"), _now())
    return failed.select("id", "attempts", "status", (F.unix_timestamp("next_retry_at") - F.unix_timestamp(_now())).alias("wait"))


@query(f"WITH {JOBS} SELECT id, CASE WHEN status = 'processing' AND updated_at < now - INTERVAL 3600 SECOND THEN 'pending' ELSE status END AS status FROM jobs")
def stale_requeue(spark: SparkSession, d: str) -> DataFrame:
    return O.requeue_stale(_jobs(spark, d), _now()).select("id", "status")


@query("""WITH k AS (SELECT user_id AS key, min(ts) AS created_at, max(ts) AS last_access, (SELECT max(ts) FROM events) AS now FROM events GROUP BY 1)
SELECT key FROM k WHERE created_at + INTERVAL 2590000 SECOND > now ORDER BY last_access DESC, key LIMIT 50""")
def ttl_lru_retention(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d)
    entries = events.groupBy(F.col("user_id").alias("key")).agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_access"))
    entries = entries.crossJoin(events.agg(F.max("ts").alias("now")))
    return O.retained(entries, F.col("now"), 2_590_000, 50).select("key")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT a.event_id, arg_min(b.event_id, b.n) AS next_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.ts > a.ts + INTERVAL 86400 SECOND GROUP BY a.event_id),
k AS (SELECT event_id FROM e WHERE n = 1 UNION ALL SELECT next_id FROM k JOIN f USING (event_id)) SELECT event_id FROM k""")
def review_dedup_24h(spark: SparkSession, d: str) -> DataFrame:
    return O.first_in_window(_events(spark, d), ["user_id", "event_type"], "ts", 86400, "event_id").select("event_id")


@query("""SELECT event_id FROM events WHERE (contains(lower(props), 'a') OR contains(event_id::VARCHAR, 'a')) AND event_type = 'purchase' AND ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-15' ORDER BY ts DESC, event_id LIMIT 100""")
def trace_filter(spark: SparkSession, d: str) -> DataFrame:
    hay = F.contains(F.lower("props"), F.lit("a")) | F.contains(F.col("event_id").cast("string"), F.lit("a"))
    rows = _events(spark, d).where(hay & (F.col("event_type") == "purchase") & F.to_date("ts").between("2024-01-05", "2024-01-15"))
    return rows.orderBy(F.desc("ts"), "event_id").limit(100).select("event_id")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 3")
def recent_n(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    return _events(spark, d).withColumn("n", n).where("n <= 3").select("user_id", "event_id")


@query("""WITH e AS (SELECT conv_id AS entry_id, list(turn ORDER BY turn) FILTER (role = 'user' AND conv_id % 3 = 0) AS explicit, list(turn ORDER BY turn) FILTER (role = 'assistant') AS key_papers FROM conversations GROUP BY 1),
p AS (SELECT entry_id, CASE WHEN len(explicit) > 0 THEN explicit ELSE key_papers END AS p FROM e) SELECT entry_id, unnest(p) AS paper_id FROM p WHERE len(p) > 0 UNION ALL SELECT entry_id, NULL FROM p WHERE p IS NULL OR len(p) = 0""")
def consumption_fanout(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "conversations").groupBy(F.col("conv_id").alias("entry_id")).agg(
        F.array_sort(F.collect_list(F.when((F.col("role") == "user") & (F.col("conv_id") % 3 == 0), F.col("turn")))).alias("explicit"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.col("turn")))).alias("key_papers"),
    )
    return O.consumption(rows)


@query("SELECT event_type, epoch(date_trunc('hour', ts))::BIGINT AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select("event_type", F.unix_timestamp("w.start").alias("hour"), "n", "total")


@query("""WITH w AS (SELECT event_type, epoch(date_trunc('hour', ts))::BIGINT - h * 3600 AS start FROM events, (SELECT unnest([0, 1, 2, 3]) AS h)) SELECT event_type, start, count(*) AS n FROM w GROUP BY ALL""")
def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).groupBy("event_type", F.window("ts", "4 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("event_type", F.unix_timestamp("w.start").alias("start"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER u + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.unix_timestamp("w.start").alias("start"), "n")


@query("SELECT user_id, event_type, round(value / sum(value) OVER (PARTITION BY user_id), 9) AS share FROM (SELECT user_id, event_type, sum(value) AS value FROM events GROUP BY ALL)")
def timing_share(spark: SparkSession, d: str) -> DataFrame:
    sums = _events(spark, d).groupBy("user_id", "event_type").agg(F.sum("value").alias("value"))
    return sums.select("user_id", "event_type", F.round(F.col("value") / F.sum("value").over(Window.partitionBy("user_id")), 9).alias("share"))


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS latest FROM events GROUP BY user_id")
def latest_value(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("latest"))


@query("SELECT event_id FROM events WHERE event_type = 'click' ORDER BY event_id OFFSET 20 LIMIT 30")
def history_page(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).where("event_type = 'click'").orderBy("event_id").offset(20).limit(30).select("event_id")


@query("SELECT event_id AS entry_id FROM events WHERE event_id % 3 = 0 OR event_id % 5 <> 0")
def mirror_outbox(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    entries = _events(spark, d).select(i.alias("entry_id"), F.lit(2).alias("version"), F.when(i % 3 == 0, F.lit(None)).when(i % 5 == 0, 2).otherwise(1).alias("mirrored_version"), F.col("ts").alias("updated_at"))
    return O.outbox(entries).select("entry_id")


@query("""WITH r AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 1 AND turn = 1 THEN 'n' WHEN conv_id % 4 = 2 AND turn = 0 THEN 's' WHEN conv_id % 4 = 3 THEN 'e' END AS k FROM conversations WHERE turn < 3),
c AS (SELECT conv_id, min(turn) FILTER (k IS NOT NULL) AS e, arg_min(k, turn) FILTER (k IS NOT NULL) AS k, max(turn) AS last FROM r GROUP BY conv_id)
SELECT conv_id AS query_id, (coalesce(e, last) + 1)::BIGINT AS rounds, CASE WHEN k = 'n' THEN 'no_evidence' WHEN k IS NOT NULL OR last = 2 THEN 'answered' ELSE 'max_iters' END AS stopped_by FROM c""")
def loop_stops(spark: SparkSession, d: str) -> DataFrame:
    """Rounds of a conversation: in every fourth one the second finds nothing, in others the first suffices, or none has a follow-up."""
    c, turn = F.col("conv_id") % 4, F.col("turn")
    said = F.when((c == 2) & (turn == 0), "sufficient").otherwise("partial")
    rounds = load(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), turn.cast("long").alias("round"), F.when((c == 1) & (turn == 1), 0).otherwise(5).alias("found"), said.alias("sufficiency"), F.when(c == 3, " ").otherwise("more").alias("follow_up"))
    return O.ended(rounds)
