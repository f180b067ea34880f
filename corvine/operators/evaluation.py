"""Evaluation of retrieval runs: metrics a query, means, coverage, gates, referential checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METRICS = ("hit_rate", "mrr", "recall", "paper_hit_rate", "citation_precision", "citation_recall", "abstain_accuracy")


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def query_metrics(runs: DataFrame) -> DataFrame:
    """Metrics of rows with ordered arrays ``retrieved, retrieved_papers, expected, expected_papers, citations``
    and ``decision, expected_abstain``.

    A decision counts as abstaining only if it is ``no_evidence``, ``abstain`` or ``weak``.
    """
    hits = F.array_distinct(F.array_intersect("retrieved", "expected"))
    first = F.array_min(F.filter(F.transform("expected", lambda x: F.array_position("retrieved", x)), lambda p: p > 0))
    expected = F.size(F.array_distinct("expected"))
    abstained = F.col("decision").isin("no_evidence", "abstain", "weak")
    return runs.select(
        "query_id",
        (F.size(hits) > 0).cast("double").alias("hit_rate"),
        F.coalesce(1 / first, F.lit(0.0)).alias("mrr"),
        ratio(F.size(hits), expected).alias("recall"),
        F.arrays_overlap("retrieved_papers", "expected_papers").cast("double").alias("paper_hit_rate"),
        ratio(F.size(F.array_intersect("citations", "retrieved")), F.size("citations")).alias("citation_precision"),
        ratio(F.size(F.array_intersect("citations", "expected")), expected).alias("citation_recall"),
        F.when(F.col("expected_abstain").isNull(), 0.0).otherwise((abstained == F.col("expected_abstain")).cast("double")).alias("abstain_accuracy"),
    )


def unpivot(metrics: DataFrame, names: tuple[str, ...] = METRICS) -> DataFrame:
    return metrics.unpivot(["query_id"], list(names), "metric", "value")


def aggregate(observations: DataFrame, *by: str) -> DataFrame:
    """Mean, count, eligible count and coverage of observations with ``metric, value, status``."""
    ok, eligible = F.col("status") == "ok", F.col("status") != "not_applicable"
    out = observations.groupBy(*by, "metric").agg(F.avg(F.when(ok, F.col("value"))).alias("mean"), F.count_if(ok).alias("count"), F.count_if(eligible).alias("eligible_count"))
    return out.withColumn("coverage", ratio(F.col("count"), F.col("eligible_count")))


def sample_status(observations: DataFrame) -> DataFrame:
    """One status a sample from those of its metrics."""
    has = lambda s: F.array_contains("seen", s)
    status = F.when(has("ok") & has("error"), "partial").when(has("ok"), "ok").when(has("error"), "error").otherwise("not_applicable")
    return observations.groupBy("query_id").agg(F.collect_set("status").alias("seen")).select("query_id", status.alias("status"))


def gates(current: DataFrame, baseline: DataFrame, fail_under: float, min_coverage: float, max_regression: float) -> DataFrame:
    """``metric, gate, value, bound`` of each violated gate."""
    joined = current.join(baseline.select("metric", F.col("mean").alias("before")), "metric", "left")
    rules = (
        ("fail_under", F.col("mean"), F.lit(fail_under), F.col("mean").isNull() | (F.col("mean") < fail_under)),
        ("min_coverage", F.col("coverage"), F.lit(min_coverage), F.col("coverage") < min_coverage),
        ("max_regression", F.col("before") - F.col("mean"), F.lit(max_regression), F.col("before") - F.col("mean") > max_regression),
    )
    each = F.explode(F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(n).alias("gate"), v.alias("value"), b.alias("bound"))) for n, v, b, bad in rules]))).alias("g")
    return joined.select("metric", each).select("metric", "g.*")


#: The schema of a report, and the fields that two reports must share to be compared.
REPORT = "ragas-report.v1"
IDENTITY = ("ragas_version", "judge_model", "embedding_model", "golden_set_sha256", "corpus_manifest_sha256")
REPORT_SCHEMA = "schema_version string, evaluation map<string,string>, aggregate_metrics map<string,struct<mean:double,coverage:double>>"


def failing(wrong: Column, message: Column) -> Column:
    """False where all is well; fails the query where it is not."""
    return F.when(wrong, F.raise_error(message).cast("boolean")).otherwise(False)


def read_report(spark: SparkSession, path: str, label: str = "report") -> DataFrame:
    """One row of a JSON report; another schema, or one without metadata or metrics, fails the read."""
    rows = spark.read.schema(REPORT_SCHEMA).option("multiLine", "true").json(path)
    wrong = F.coalesce(F.col("schema_version") != REPORT, F.lit(True)) | F.col("evaluation").isNull() | F.col("aggregate_metrics").isNull()
    return rows.where(~failing(wrong, F.lit(f"{label} must use schema {REPORT}, with evaluation and aggregate_metrics")))


def report_gates(report: DataFrame, fail_under: dict[str, float], min_coverage: dict[str, float], max_regression: dict[str, float], baseline: DataFrame | None = None) -> DataFrame:
    """``gate, metric, actual, baseline, bound`` of each gate that a report violates; reports are rows of ``read_report``.

    A metric that a report lacks, a regression gate without a baseline, and a baseline of another identity fail the query.
    """
    if max_regression and baseline is None:
        raise ValueError("max_regression needs a baseline")
    rows = report.select("evaluation", F.col("aggregate_metrics").alias("now"))
    none = F.lit(None).cast(report.schema["aggregate_metrics"].dataType)
    if baseline is not None:
        rows = rows.join(F.broadcast(baseline.select(F.col("evaluation").alias("other"), F.col("aggregate_metrics").alias("before"))))  # one row
        apart = F.array_compact(F.array(*[F.when(~F.col("evaluation")[f].eqNullSafe(F.col("other")[f]), f) for f in IDENTITY]))
        rows = rows.where(~failing(F.size(apart) > 0, F.concat(F.lit("baseline is not comparable; mismatched: "), F.array_join(apart, ", "))))
    else:
        rows = rows.withColumn("before", none)
    out = []
    for gate, bounds in (("fail_under", fail_under), ("min_coverage", min_coverage), ("max_regression", max_regression)):
        for metric, bound in bounds.items():
            now, before = F.col("now")[metric], F.col("before")[metric]
            actual = now["coverage"] if gate == "min_coverage" else now["mean"]
            absent = now.isNull() | (before.isNull() if gate == "max_regression" else F.lit(False))
            bad = before["mean"] - actual > bound if gate == "max_regression" else actual < bound
            bad = failing(absent, F.lit(f"a report does not contain metric: {metric}")) | bad
            shown = before["mean"] if gate == "max_regression" else F.lit(None).cast("double")
            out.append(F.when(bad, F.struct(F.lit(gate).alias("gate"), F.lit(metric).alias("metric"), actual.alias("actual"), shown.alias("baseline"), F.lit(float(bound)).alias("bound"))))
    gates_ = F.array_compact(F.array(*out)) if out else F.array().cast("array<struct<gate:string,metric:string,actual:double,baseline:double,bound:double>>")
    return rows.select(F.explode(gates_).alias("g")).select("g.*")


def referential_problems(golden: DataFrame, chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """``case_id, problem, ref`` of golden rows ``case_id, chunk_id, paper_id`` against a corpus."""
    chunks = chunks.select("chunk_id", F.col("paper_id").alias("owner"))
    joined = golden.join(chunks, "chunk_id", "left").join(papers.select("paper_id", "status"), "paper_id", "left")
    problem = F.when(F.col("status").isNull(), "missing_paper").when(F.col("status") != "done", "paper_not_done").when(F.col("owner").isNull(), "missing_chunk").when(F.col("owner") != F.col("paper_id"), "wrong_paper")
    return joined.select("case_id", problem.alias("problem"), F.col("chunk_id").alias("ref")).where("problem is not null")


#: Bins that a group's range is cut into to find where a quantile lies.
BINS = 2048


def index_quantiles(frame: DataFrame, by: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """``by`` and ``p50, p95, ...``: of each group the sorted value at ``floor(q n)``, the last at most; nulls do not count.

    No group is gathered: one pass takes its size and range, one counts ``BINS`` bins of it, and one counts the values of
    the bins in which a quantile lies, which a window then walks in their order.  Infinite values and NaN have bins of their own.
    """
    rows = frame.select(F.struct(by).alias("g"), F.col(value).cast("double").alias("v"))  # a structure, so that a null group meets itself
    finite = F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v"))
    sizes = rows.groupBy("g").agg(F.count("v").alias("n"), F.min(finite).alias("low"), F.max(finite).alias("high"))
    known = rows.where("v is not null").join(sizes, "g")
    inside = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1))).otherwise(0)
    place = F.when(F.isnan("v"), BINS + 1).when(F.col("v") == float("inf"), BINS).when(F.col("v") == float("-inf"), -1).otherwise(inside)
    binned = known.withColumn("bin", place.cast("int"))
    counts = binned.groupBy("g", "n", "bin").agg(F.count("*").alias("here"))
    upto = F.sum("here").over(Window.partitionBy("g").orderBy("bin"))  # BINS + 3 rows a group at most
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n"))).alias("rank")) for i, q in enumerate(shares)])).alias("q")
    wanted = counts.withColumn("upto", upto).select("g", "bin", "here", "upto", asked).where((F.col("q.rank") >= F.col("upto") - F.col("here")) & (F.col("q.rank") < F.col("upto")))
    wanted = wanted.select("g", "bin", F.col("q.i").alias("i"), (F.col("q.rank") - F.col("upto") + F.col("here")).alias("rank"))
    values = binned.join(wanted.select("g", "bin").distinct(), ["g", "bin"], "left_semi").groupBy("g", "bin", "v").agg(F.count("*").alias("times"))
    ends = F.sum("times").over(Window.partitionBy("g", "bin").orderBy("v"))
    found = values.withColumn("ends", ends).join(wanted, ["g", "bin"]).where((F.col("rank") >= F.col("ends") - F.col("times")) & (F.col("rank") < F.col("ends")))
    out = found.groupBy("g").agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"p{round(100 * q)}") for i, q in enumerate(shares)])
    return sizes.select("g").join(out, "g", "left").select(F.col("g")[by].alias(by), *out.columns[1:])


def composite(backends: dict[str, DataFrame]) -> DataFrame:
    """Long metrics ``query_id, metric, value`` of several evaluators, names prefixed by the evaluator's."""
    out = None
    for name, frame in backends.items():
        own = frame.select("query_id", F.concat(F.lit(f"{name}."), "metric").alias("metric"), F.col("value").cast("double").alias("value"))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("a composite needs an evaluator")
    return out


def parse_thresholds(values: list[str], supported: tuple[str, ...] = METRICS) -> dict[str, float]:
    """``metric=value`` pairs; unknown metrics and values outside 0 to 1 are errors."""
    out = {}
    for value in values:
        name, _, number = value.partition("=")
        if name not in supported:
            raise ValueError(f"unknown metric {name!r}")
        if not 0 <= (bound := float(number)) <= 1:
            raise ValueError(f"{name}: {number} is not between 0 and 1")
        out[name] = bound
    return out
