"""The question-answering chain over a batch of questions: retrieve, decide, select, cite."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import models
from ..functions import text as T
from ..operators import fanout
from ..operators import operations as O
from ..operators import retrieval as R
from ..operators.postings import Index


@dataclass(frozen=True)
class Settings:
    """Parameters of the chain and its hooks; a hook takes and gives columns or frames."""

    top_k: int = 10
    rrf_k: int = 60
    pool: int = 20
    per_paper: int = 50
    penalty: float = 0.15
    low: float = 0.21
    high: float = 0.48
    most_evidence: int = 4
    encoder: Callable[[], models.Encoder] = models.hashing_encoder
    reranker: Callable[[Column, Column], Column] = T.overlap
    sparse: str = "fts"
    index: Index | None = None
    vectors: DataFrame | None = None
    rewrite: Callable[[DataFrame], DataFrame] | None = None


def retrieve(chunks: DataFrame, questions: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Ranked rows of each question: both legs fused, penalised, reranked in a window of three times ``top_k``, spread over papers.

    With a kept ``index`` and kept ``vectors`` (``chunk_id, vector``) no chunk is tokenised or encoded again; with ``rewrite``
    (``fanout.rewrites``) each question is asked in its variants and modalities.
    """
    s = settings
    vectors = s.vectors if s.vectors is not None else models.embed(chunks, "chunk_id", "text", s.encoder)
    by_term = lambda asked: s.index.search(asked, s.sparse, s.pool) if s.index is not None else R.bm25(chunks, asked, s.sparse, s.pool)
    if s.rewrite is not None:
        points = vectors.select("chunk_id", "vector").join(chunks.select("chunk_id", "modality"), "chunk_id")

        def by_vector(asked: DataFrame) -> DataFrame:
            own = models.embed(asked, "spec_id", "query", s.encoder).join(asked.select("spec_id", "modality"), "spec_id")
            return R.dense(points, own.withColumnRenamed("spec_id", "query_id"), s.pool, "modality")

        return fanout.retrieve(s.rewrite(questions), chunks, by_vector, by_term, fanout.Round(s.pool, s.top_k, s.rrf_k, s.penalty, s.per_paper), s.reranker)
    dense = R.dense(vectors, models.embed(questions, "query_id", "query", s.encoder), s.pool)
    sparse = by_term(questions)
    fused = R.fused_top(R.rrf([(dense, "rank_dense"), (sparse, "rank_bm25")], s.rrf_k), 2 * s.pool)
    rows = fused.join(chunks, "chunk_id").join(questions, "query_id")
    intent = T.reference_intent(F.col("query"))
    rows = R.penalise(rows, s.penalty, intent)
    window = R.best(rows.withColumnRenamed("position", "fused"), ["query_id"], [F.desc("score_effective"), F.asc("fused")], 3 * s.top_k, "place")
    scored = R.penalise(models.rerank(window, s.reranker), s.penalty, intent)
    return R.diversify(scored, s.per_paper, s.top_k, [F.desc("score_effective"), F.asc("place")])


def loop(chunks: DataFrame, questions: DataFrame, settings: Settings = Settings(), reflect: Callable[[Column, Column], Column] | None = None, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rows found for a batch of questions in up to ``rounds`` rounds, and the trace of the rounds.

    ``reflect`` takes columns of question and evidence and gives a model's reply; a question whose evidence does not suffice
    is asked again by the follow-up in that reply.  A chunk keeps its row of the first round that found it.  The trace has ``query_id, round,
    query, found, sufficiency, follow_up, stopped_by``, the last null while the next round follows.
    """
    asked = questions.select("query_id", "query")
    current, pools, traces = asked, [], []
    for place in range(rounds if reflect else 1):
        rows = retrieve(chunks, current, settings).withColumn("round", F.lit(place)).persist()
        lines = F.array_sort(F.collect_list(F.struct((-F.col("score_effective")).alias("s"), F.col("chunk_id").alias("id"), F.col("text").alias("text"))))
        seen = rows.groupBy("query_id").agg(F.count("*").alias("found"), F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("context"))
        seen = current.join(seen, "query_id", "left").join(asked.select("query_id", F.col("query").alias("question")), "query_id")
        said = models.reflection(reflect(F.col("question"), F.coalesce("context", F.lit("")))) if reflect else F.lit(None).cast("struct<sufficiency:string,score:double,follow_up:string>")
        found = F.coalesce("found", F.lit(0))
        round_ = seen.select("query_id", F.lit(place).alias("round"), "query", found.alias("found"), said.alias("r"))
        round_ = round_.select("query_id", "round", "query", "found", "r.sufficiency", "r.follow_up")
        trace = round_.withColumn("stopped_by", O.stop_reason(F.col("found"), F.col("sufficiency"), F.col("follow_up"), F.lit(place >= rounds - 1))).persist()
        pools.append(rows.drop("query"))
        traces.append(trace)
        current = trace.where("stopped_by is null").select("query_id", F.col("follow_up").alias("query"))
    pool, log = pools[0], traces[0]
    for more, trace in zip(pools[1:], traces[1:]):
        pool, log = pool.unionByName(more), log.unionByName(trace)
    first = R.best(pool, ["query_id", "chunk_id"], [F.asc("round")], 1, "earlier").drop("earlier")
    return first.join(asked, "query_id"), log


def prompt(question: Column, context: Column, evidence: Column, weak: Column) -> Column:
    """What the chat model gets: question, evidence, the citation tokens that it may copy, and a hint where the evidence is weak."""
    allowed = F.array_join(F.transform(evidence, lambda i: F.concat(F.lit("[chunk:"), i, F.lit("]"))), " ")
    hint = F.when(weak, "\n\nThe evidence is weak: say what stays uncertain, and do not fill gaps.").otherwise("")
    rule = F.lit("\n\nCite at most 2 of them, copied as they stand, and only where they support the answer.")
    return F.concat(F.lit("Question: "), question, F.lit("\n\nEvidence:\n"), context, F.lit("\n\nAllowed citations: "), allowed, rule, hint)


def answer(chunks: DataFrame, questions: DataFrame, settings: Settings = Settings(), chat: Callable[[Column], Column] | None = None, reflect: Callable[[Column, Column], Column] | None = None, rounds: int = 3) -> DataFrame:
    """``query_id, decision, evidence, answer, citations, stopped_by``; without ``chat`` the evidence is the answer.

    ``chat`` gets the prompt and gives an answer, null if it failed.  Citations that name no evidence are taken out, as are forms of
    citation that name no chunk.  ``stopped_by`` is no_chunks, no_evidence_abstain, chat_error, or what ended the rounds.
    """
    rows, log = loop(chunks, questions, settings, reflect, rounds)
    ended = log.groupBy("query_id").agg(F.max_by("stopped_by", "round").alias("ended"))
    decided = R.decide(rows, settings.low, settings.high)
    chosen = R.select_evidence(rows, settings.most_evidence)
    line = F.concat(F.lit("[chunk:"), F.col("chunk_id").cast("string"), F.lit("] "), T.clip(F.col("text"), 1500))
    packed = F.array_sort(F.collect_list(F.struct("selected", F.col("chunk_id").cast("string").alias("id"), line.alias("line"))))
    evidence = chosen.groupBy("query_id").agg(packed.alias("e")).select("query_id", F.transform("e", lambda x: x["id"]).alias("evidence"), F.array_join(F.transform("e", lambda x: x["line"]), "\n").alias("context"))
    out = questions.join(decided.select("query_id", "decision"), "query_id", "left").join(evidence, "query_id", "left").join(ended, "query_id", "left")
    none = F.array().cast("array<string>")
    decision = F.coalesce("decision", F.lit("no_chunks"))
    context, ids = F.coalesce("context", F.lit("")), F.coalesce("evidence", none)
    said = chat(prompt(F.col("query"), context, ids, decision == "weak_evidence")) if chat else context
    silent = decision.isin("no_chunks", "no_evidence")
    out = out.select("query_id", decision.alias("decision"), ids.alias("evidence"), F.when(silent, "").otherwise(said).alias("said"), "ended")
    ended_by = F.when(F.col("decision") == "no_chunks", "no_chunks").when(F.col("decision") == "no_evidence", "no_evidence_abstain").when(F.col("said").isNull(), "chat_error").otherwise(F.col("ended"))
    out = out.select("query_id", "decision", "evidence", F.coalesce("said", F.lit("")).alias("said"), ended_by.alias("stopped_by"))
    clean = T.without_suspicious(T.without_invalid(F.col("said"), F.col("evidence")))
    return out.select("query_id", "decision", "evidence", clean.alias("answer"), T.valid_citations(F.col("said"), F.col("evidence")).alias("citations"), "stopped_by")


def events(answers: DataFrame) -> DataFrame:
    """``query_id, seq, event, data``: what a client sees of each question, in order."""
    one = lambda name, data: F.struct(F.lit(name).alias("event"), data.alias("data"))
    steps = F.array(one("retrieved", F.to_json("evidence")), one("abstain", F.col("decision")), one("answer_chunk", F.col("answer")), one("done", F.to_json("citations")))
    return answers.select("query_id", F.posexplode(steps).alias("seq", "e")).select("query_id", "seq", "e.event", "e.data")
