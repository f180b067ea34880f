"""Queries of the evaluation subsystem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import retrieval as R
from ..tables import chunks, load, questions
from .registry import registry
from .retrieval import FTS

QUERIES, SQL, query = registry()


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """BM25 runs of the questions; documents that contain a question's text are what is expected."""
    found = R.bm25(chunks(spark, d), questions(spark, d), "fts")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rank_bm25", c))), lambda x: x[c])
    runs = found.groupBy("query_id").agg(ordered("chunk_id").alias("retrieved"), ordered("paper_id").alias("retrieved_papers"))
    q = questions(spark, d)
    truth = R.containing(chunks(spark, d), q)
    truth = truth.groupBy("query_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("expected"), F.collect_set("paper_id").alias("expected_papers"))
    rows = q.select("query_id").join(runs, "query_id", "left").join(truth, "query_id", "left")
    empty = lambda c, k: F.coalesce(c, F.array().cast(f"array<{k}>")).alias(c)
    rows = rows.select("query_id", empty("retrieved", "bigint"), empty("retrieved_papers", "string"), empty("expected", "bigint"), empty("expected_papers", "string"))
    return rows.withColumns({"citations": F.slice("retrieved", 1, 3), "decision": F.when(F.size("retrieved") > 0, "confident").otherwise("no_evidence"), "expected_abstain": F.size("expected") == 0})


METRICS = f"""{FTS}, t AS (SELECT item_id AS query_id, doc_id AS chunk_id, source AS paper_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
n AS (SELECT query_id, count(DISTINCT chunk_id) AS expected FROM t GROUP BY 1),
h AS (SELECT s.query_id, count(DISTINCT s.chunk_id) AS hits, min(rank_bm25) AS first, count(DISTINCT s.chunk_id) FILTER (rank_bm25 < 3) AS cited FROM sparse s JOIN t USING (query_id, chunk_id) GROUP BY 1),
p AS (SELECT DISTINCT s.query_id FROM sparse s JOIN t USING (query_id, paper_id)),
c AS (SELECT query_id, least(count(*), 3) AS citations FROM sparse GROUP BY 1),
m AS (SELECT item_id AS query_id, (coalesce(hits, 0) > 0)::INT::DOUBLE AS hit_rate, coalesce(1.0::DOUBLE / (first + 1), 0) AS mrr, coalesce(hits::DOUBLE / expected, 0) AS recall, (p.query_id IS NOT NULL)::INT::DOUBLE AS paper_hit_rate,
  CASE WHEN citations > 0 THEN 1.0::DOUBLE ELSE 0 END AS citation_precision, coalesce(cited::DOUBLE / expected, 0) AS citation_recall, ((citations IS NULL) = (expected IS NULL))::INT::DOUBLE AS abstain_accuracy
  FROM benchmark LEFT JOIN n ON n.query_id = item_id LEFT JOIN h ON h.query_id = item_id LEFT JOIN p ON p.query_id = item_id LEFT JOIN c ON c.query_id = item_id)"""


@query(f"WITH {METRICS} SELECT * FROM m")
def retrieval_metrics_per_query(spark: SparkSession, d: str) -> DataFrame:
    return E.query_metrics(_runs(spark, d))


@query(f"WITH {METRICS}, u AS (UNPIVOT m ON {', '.join(E.METRICS)} INTO NAME metric VALUE value) SELECT metric, round(avg(value), 9) AS mean FROM u GROUP BY metric")
def retrieval_metrics_mean(spark: SparkSession, d: str) -> DataFrame:
    return E.unpivot(E.query_metrics(_runs(spark, d))).groupBy("metric").agg(F.round(F.avg("value"), 9).alias("mean"))


OBSERVED = """o AS (SELECT doc_id AS query_id, 'quality' AS metric, quality::DOUBLE AS value, CASE WHEN doc_id % 9 = 0 THEN 'error' WHEN doc_id % 7 = 0 THEN 'not_applicable' ELSE 'ok' END AS status FROM labels
  UNION ALL SELECT doc_id, 'toxic', toxic::DOUBLE, CASE WHEN doc_id % 5 = 0 THEN 'error' ELSE 'ok' END FROM labels)"""
AGGREGATED = "count(*) FILTER (status = 'ok') AS count, count(*) FILTER (status <> 'not_applicable') AS eligible_count, round(avg(value) FILTER (status = 'ok'), 9) AS mean, round(coalesce(count(*) FILTER (status = 'ok') / nullif(count(*) FILTER (status <> 'not_applicable'), 0), 0), 9) AS coverage"


def _observed(spark: SparkSession, d: str) -> DataFrame:
    labels = load(spark, d, "labels")
    first = F.when(F.col("doc_id") % 9 == 0, "error").when(F.col("doc_id") % 7 == 0, "not_applicable").otherwise("ok")
    quality = labels.select(F.col("doc_id").alias("query_id"), F.lit("quality").alias("metric"), F.col("quality").cast("double").alias("value"), first.alias("status"))
    toxic = labels.select("doc_id", F.lit("toxic"), F.col("toxic").cast("double"), F.when(F.col("doc_id") % 5 == 0, "error").otherwise("ok"))
    return quality.union(toxic)


def _round(frame: DataFrame) -> DataFrame:
    return frame.withColumns({"mean": F.round("mean", 9), "coverage": F.round("coverage", 9)})


@query(f"WITH {OBSERVED}, g AS (SELECT *, unnest(['all', 'mod' || query_id % 3]) AS tag FROM o) SELECT tag, metric, {AGGREGATED} FROM g GROUP BY ALL")
def metric_coverage_by_tag(spark: SparkSession, d: str) -> DataFrame:
    tags = F.explode(F.array(F.lit("all"), F.concat(F.lit("mod"), (F.col("query_id") % 3).cast("string"))))
    return _round(E.aggregate(_observed(spark, d).withColumn("tag", tags), "tag"))


@query(f"WITH {OBSERVED} SELECT query_id, CASE WHEN count(*) FILTER (status = 'ok') > 0 AND count(*) FILTER (status = 'error') > 0 THEN 'partial' WHEN count(*) FILTER (status = 'ok') > 0 THEN 'ok' WHEN count(*) FILTER (status = 'error') > 0 THEN 'error' ELSE 'not_applicable' END AS status FROM o GROUP BY query_id")
def sample_status(spark: SparkSession, d: str) -> DataFrame:
    return E.sample_status(_observed(spark, d))


@query(f"""WITH {OBSERVED}, a AS (SELECT metric, {AGGREGATED} FROM o WHERE query_id % 2 = 0 GROUP BY metric), b AS (SELECT metric, round(avg(value) FILTER (status = 'ok'), 9) AS before FROM o WHERE query_id % 2 = 1 GROUP BY metric), j AS (SELECT * FROM a LEFT JOIN b USING (metric)),
g AS (SELECT metric, 'fail_under' AS gate, mean AS value, 0.5 AS bound FROM j WHERE mean IS NULL OR mean < 0.5 UNION ALL SELECT metric, 'min_coverage', coverage, 0.9 FROM j WHERE coverage < 0.9 UNION ALL SELECT metric, 'max_regression', before - mean, 0.001 FROM j WHERE before - mean > 0.001)
SELECT metric, gate, round(value, 6) AS value, bound::DOUBLE AS bound FROM g""")
def regression_gates(spark: SparkSession, d: str) -> DataFrame:
    seen = _observed(spark, d)
    now, before = _round(E.aggregate(seen.where("query_id % 2 = 0"))), _round(E.aggregate(seen.where("query_id % 2 = 1")))
    return E.gates(now, before, 0.5, 0.9, 0.001).withColumn("value", F.round("value", 6))


@query("""WITH g AS (SELECT doc_id AS case_id, doc_id + 300 AS chunk_id, CASE WHEN doc_id % 4 = 0 THEN 'src99' WHEN doc_id % 4 = 1 THEN 'src5' ELSE 'src' || ((doc_id + 300) % 20) END AS paper_id FROM labels), p AS (SELECT DISTINCT source AS paper_id, CASE WHEN source = 'src5' THEN 'parsed' ELSE 'done' END AS status FROM documents)
SELECT case_id, problem, ref FROM (SELECT case_id, g.chunk_id AS ref, CASE WHEN status IS NULL THEN 'missing_paper' WHEN status <> 'done' THEN 'paper_not_done' WHEN d.doc_id IS NULL THEN 'missing_chunk' WHEN d.source <> g.paper_id THEN 'wrong_paper' END AS problem FROM g LEFT JOIN documents d ON d.doc_id = g.chunk_id LEFT JOIN p USING (paper_id)) WHERE problem IS NOT NULL""")
def golden_referential_check(spark: SparkSession, d: str) -> DataFrame:
    paper = F.when(F.col("doc_id") % 4 == 0, "src99").when(F.col("doc_id") % 4 == 1, "src5").otherwise(F.concat(F.lit("src"), ((F.col("doc_id") + 300) % 20).cast("string")))
    golden = load(spark, d, "labels").select(F.col("doc_id").alias("case_id"), (F.col("doc_id") + 300).alias("chunk_id"), paper.alias("paper_id"))
    corpus = chunks(spark, d)
    papers = corpus.select("paper_id").distinct().withColumn("status", F.when(F.col("paper_id") == "src5", "parsed").otherwise("done"))
    return E.referential_problems(golden, corpus, papers)


@query("SELECT sha256(string_agg(source, chr(10) ORDER BY source)) AS manifest FROM (SELECT DISTINCT source FROM documents)")
def corpus_manifest(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("source")), "\n"), 256).alias("manifest"))


@query("SELECT doc_id AS query_id, 'a.quality' AS metric, quality::DOUBLE AS value FROM labels UNION ALL SELECT doc_id, 'b.toxic', toxic::DOUBLE FROM labels WHERE doc_id % 2 = 0")
def composite_metrics(spark: SparkSession, d: str) -> DataFrame:
    labels = load(spark, d, "labels").withColumnRenamed("doc_id", "query_id")
    one = lambda c: labels.select("query_id", F.lit(c).alias("metric"), F.col(c).alias("value"))
    return E.composite({"a": one("quality"), "b": one("toxic").where("query_id % 2 = 0")})


@query("SELECT doc_id FROM labels WHERE quality * 0.5 + (doc_id % 10) / 20 >= 0.7")
def self_evaluation_gate(spark: SparkSession, d: str) -> DataFrame:
    score = F.col("quality") * 0.5 + (F.col("doc_id") % 10) / 20
    return load(spark, d, "labels").where(F.round(score, 9) >= 0.7).select("doc_id")
