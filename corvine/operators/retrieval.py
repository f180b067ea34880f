"""Ranking operators: BM25, dense top-k, fusion, pooling, penalties, quotas, evidence."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.batches import pieces
from .topk import TopK

#: Dense queries of one block, as all tasks get a block's vectors; more queries are more blocks.
MOST_QUERIES = 4096
#: Texts of queries or phrases of one block, terms that a task holds before it sends their counts.
MOST_TEXTS, MOST_TERMS = 1024, 1 << 17
#: Scores of one matrix product; where a list is not full yet, all of them are sorted, which takes some hundred bytes a score.
MOST_SCORES = 1 << 18
#: Scores that tell relevance, best first, and those that only rank.
SCORE_FIELDS = ("score_effective", "score_rerank", "score_dense", "score", "score_bm25", "score_rrf")
LOW_QUALITY = ("score_bm25", "score_rrf")


def best(frame: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, with a rank from 0; Spark limits groups before the shuffle."""
    numbered = frame.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return numbered.where(F.col(rank) <= k).withColumn(rank, F.col(rank) - 1)


#: k1 and b of the two variants.
BM25 = {"okapi": (1.5, 0.75), "fts": (1.2, 0.75)}


def spread(frame: DataFrame) -> DataFrame:
    """A frame of fewer partitions than there are cores, which is a small one, dealt to all of them."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def bm25(chunks: DataFrame, queries: DataFrame, variant: str = "okapi", top_k: int = 20, paper_ids: DataFrame | None = None) -> DataFrame:
    """``query_id, chunk_id, paper_id, score_bm25, rank_bm25`` for queries of any number, in blocks of ``MOST_TEXTS``.

    ``okapi`` has k1 1.5 and gives terms of more than half of the chunks a quarter of the mean idf;
    ``fts`` has k1 1.2 and an idf floor.  Statistics cover all chunks, a paper filter comes after.

    One pass counts document frequencies within tasks, which send a term's count once a ``MOST_TERMS`` terms; where
    only the idf of one block's terms is asked for, others are not counted.  A second one scores every chunk against
    a block's terms, which go to all tasks, and keeps ``top_k`` rows a query and task.
    No postings are shuffled, so no frequent word is a hot key.
    """
    k1, b = BM25[variant]
    texts = spread(chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "text"))
    asked, found = queries.select("query_id", "query").toLocalIterator(), None
    first = list(islice(asked, MOST_TEXTS))
    only = {t for r in first for t in T.index_terms(r["query"])} if variant == "fts" and len(first) < MOST_TEXTS else None
    n, mean_size, df, mean_idf = _statistics(texts, variant == "okapi", only)
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    if paper_ids is not None:
        texts = texts.join(chunks.join(paper_ids, "paper_id", "left_semi").select("chunk_id"), "chunk_id", "left_semi")
    asked, spark = chain(first, asked), chunks.sparkSession
    while (block := list(islice(asked, MOST_TEXTS))) or found is None:
        terms = [Counter(T.index_terms(r["query"])) for r in block]
        wanted = spark.createDataFrame([(t,) for t in sorted(set().union(*terms))], "term string")
        known = {r["term"]: r["idf"] for r in df.join(F.broadcast(wanted), "term").select("term", idf.alias("idf")).toLocalIterator()}
        known = {t: (0.25 * mean_idf if v < 0 else v) if variant == "okapi" else max(v, 1e-6) for t, v in sorted(known.items())}
        number = {t: i for i, t in enumerate(known)}
        weights = np.zeros((len(number), len(block)))
        for q, own in enumerate(terms):
            for t, times in own.items():
                if t in number:
                    weights[number[t], q] = times * known[t] * (k1 + 1)
        shared = spark.sparkContext.broadcast((np.array([r["query_id"] for r in block], np.int64), number, weights))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, number, weights = shared.value
            top = TopK(len(ids), top_k)
            for part in pieces(batches, max(1, MOST_SCORES // max(len(ids), 1))):
                row, term, tfs, norms = [], [], [], []
                for text in part.column(1).to_pylist():
                    tokens = T.index_terms(text)
                    own = [(number[t], tf) for t, tf in Counter(tokens).items() if t in number]
                    row.append(len(own))
                    term += [t for t, _ in own]
                    tfs += [tf for _, tf in own]
                    norms.append(k1 * (1 - b + b * len(tokens) / mean_size) if mean_size else 0.0)
                if not term:
                    continue
                used, column = np.unique(np.array(term), return_inverse=True)
                at, tf = np.repeat(np.arange(len(row)), row), np.array(tfs, float)
                dense = np.zeros((len(row), len(used)))
                dense[at, column] = tf / (tf + np.array(norms)[at])
                score = np.round(dense @ weights[used], 9)
                score[score <= 0] = -np.inf
                top.offer(score, part.column(0).to_numpy())
            yield top.batch(ids, ["query_id", "chunk_id", "score_bm25"])

        some = texts.mapInArrow(search, "query_id long, chunk_id long, score_bm25 double")
        found = some if found is None else found.unionByName(some)
    df.unpersist()
    ranked = best(found, ["query_id"], [F.desc("score_bm25"), F.asc("chunk_id")], top_k, "rank_bm25")
    return ranked.join(chunks.select("chunk_id", "paper_id"), "chunk_id").select("query_id", "chunk_id", "paper_id", "score_bm25", "rank_bm25")


def _statistics(texts: DataFrame, mean: bool, only: set[str] | None = None) -> tuple[int, float, DataFrame, float]:
    """Number of texts, mean of their sizes in terms, ``term, df`` of all terms or those in ``only`` (persisted), and the mean idf of all if wanted."""
    shared = None if only is None else texts.sparkSession.sparkContext.broadcast(only)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter[str] = Counter()
        rows = size = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([None, *df], pa.string()), pa.array([rows, *df.values()], pa.int64()), pa.array([size, *[0] * len(df)], pa.int64())], ["term", "df", "size"])
            df.clear()
            return out

        wanted = None if shared is None else shared.value
        for part in pieces(batches):
            for text in part.column(0).to_pylist():
                tokens = T.index_terms(text)
                rows, size = rows + 1, size + len(tokens)
                df.update(set(tokens) if wanted is None else wanted.intersection(tokens))
            if len(df) > MOST_TERMS:
                yield flush()
                rows = size = 0
        yield flush()

    counted = texts.select("text").mapInArrow(count, "term string, df long, size long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("size").alias("size")).persist()
    all_ = counted.where("term is null").first()
    n, size = (all_["df"], all_["size"]) if all_ else (0, 0)
    df = counted.where("term is not null")
    middle = df.agg(F.avg(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("m")).first()["m"] if mean else None
    return n, size / n if n else 0.0, counted, middle or 0.0


def dense(points: DataFrame, queries: DataFrame, top_k: int = 20, within: str | None = None) -> DataFrame:
    """``query_id, chunk_id, score_dense, rank_dense`` by cosine; ``points`` has ``chunk_id, vector``.

    With ``within``, a column of both, a query where it is not null gets only points that have the same value.

    The query vectors go to all tasks in blocks of ``MOST_QUERIES``, as many as there are; a task keeps
    its ``top_k`` of each query from a matrix product, so that the shuffle is ``top_k`` rows a query and task.
    The driver holds one block of rows at a time.
    """
    kind = F.lit(None).cast("string") if within is None else F.col(within).cast("string")
    points = points.select("chunk_id", "vector", kind.alias("kind")).where("vector is not null")
    asked = queries.select("query_id", "vector", kind.alias("kind")).toLocalIterator()
    found = None
    while (block := list(islice(asked, MOST_QUERIES))) or found is None:
        some = _search(points, block, top_k)
        found = some if found is None else found.unionByName(some)
    return best(found, ["query_id"], [F.desc("score_dense"), F.asc("chunk_id")], top_k, "rank_dense")


def _search(points: DataFrame, asked: Sequence[Row], top_k: int) -> DataFrame:
    """Each task's ``top_k`` points of each query of a block."""
    ids = np.array([r["query_id"] for r in asked], np.int64)
    unit = np.array([np.asarray(r["vector"], float) / max(np.linalg.norm(np.asarray(r["vector"], float)), 1e-30) for r in asked])
    kinds = {k: np.array([r["kind"] == k for r in asked]) for k in {r["kind"] for r in asked} - {None}}
    shared = points.sparkSession.sparkContext.broadcast((ids, unit, kinds))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit, kinds = shared.value
        top = TopK(len(ids), top_k)
        for part in pieces(batches, max(1, MOST_SCORES // len(ids))) if len(ids) else ():
            values = part.column(1)
            rows = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).astype(float)
            score = (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)) @ unit.T
            score = np.round(score, 9)
            if kinds:
                own = part.column(2).to_numpy(zero_copy_only=False)
                for kind, queries in kinds.items():
                    score[np.ix_(own != kind, queries)] = -np.inf
            top.offer(score, part.column(0).to_numpy())
        yield top.batch(ids, ["query_id", "chunk_id", "score_dense"])

    return points.mapInArrow(search, "query_id long, chunk_id long, score_dense double")


def containing(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, chunk_id, paper_id`` where a chunk's text has the query's text in it, by one automaton a block of queries."""
    import ahocorasick

    asked, found = queries.select("query_id", "query").where("query is not null").toLocalIterator(), None
    while (block := list(islice(asked, MOST_TEXTS))) or found is None:
        of: dict[str, list[int]] = {}
        for r in block:
            of.setdefault(r["query"], []).append(r["query_id"])
        shared = chunks.sparkSession.sparkContext.broadcast(of)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            everywhere, automaton = shared.value.get("", []), ahocorasick.Automaton()
            for text, ids in shared.value.items():
                if text:
                    automaton.add_word(text, ids)
            automaton.make_automaton()
            for batch in pieces(batches):
                pairs = []
                for row, text in enumerate(batch.column(2).to_pylist()):
                    if text is not None:
                        ids = set(everywhere)
                        ids.update(*(own for _, own in automaton.iter(text))) if len(automaton) else None
                        pairs += [(q, row) for q in sorted(ids)]
                at = pa.array([row for _, row in pairs], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in pairs], pa.int64()), batch.column(0).take(at), batch.column(1).take(at)], ["query_id", "chunk_id", "paper_id"])

        some = spread(chunks.select("chunk_id", "paper_id", "text")).mapInArrow(search, "query_id long, chunk_id long, paper_id string")
        found = some if found is None else found.unionByName(some)
    return found


def rrf(legs: Sequence[tuple[DataFrame, str]], k: int = 60, keep: Sequence[str] = ()) -> DataFrame:
    """Reciprocal rank fusion of ranked lists; ``legs`` are frames with the names of their ranks.

    Fields in ``keep`` come from the first leg that has them.  Equal scores keep the order of first
    appearance: leg by leg, by rank.
    """
    union = None
    for place, (leg, rank) in enumerate(legs):
        own = leg.select("query_id", "chunk_id", F.lit(place).alias("leg"), F.col(rank).alias("rank"), *[(F.col(c) if c in leg.columns else F.lit(None)).alias(c) for c in keep])
        union = own if union is None else union.unionByName(own)
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("leg"))).alias(c) for c in keep]
    share = F.lit(1.0) / (k + F.col("rank") + 1)
    union = union.where("chunk_id is not null")  # such rows have used up their ranks
    return union.groupBy("query_id", "chunk_id").agg(F.round(F.sum(share), 9).alias("score_rrf"), F.min(F.struct("leg", "rank")).alias("seen"), *first)


def fused_top(fused: DataFrame, top: int) -> DataFrame:
    ranked = best(fused, ["query_id"], [F.desc("score_rrf"), F.asc("seen"), F.asc("chunk_id")], top, "position")
    return ranked.drop("seen")


def pool(rows: DataFrame, score: str = "score_rrf", order: str = "seq") -> DataFrame:
    """Of each chunk of a query the row with the highest score, the earliest of equals."""
    return best(rows, ["query_id", "chunk_id"], [F.desc(score), F.asc(order)], 1, "pooled").drop("pooled")


def penalise(rows: DataFrame, factor: float = 0.15, intent: Column | None = None) -> DataFrame:
    """Adds ``score_effective`` and ``reference_penalized``: references count ``factor`` unless asked for."""
    names = [c for c in ("score_rerank", "score_rrf", "score_dense", "score", "score_bm25") if c in rows.columns]
    raw = F.coalesce(*[F.col(c) for c in names], F.lit(0.0))
    hit = T.is_reference(F.col("section")) & ~(F.lit(False) if intent is None else intent)
    own = {"score_rerank_raw": F.col("score_rerank").cast("double")} if "score_rerank" in rows.columns else {}
    return rows.withColumns(own | {"reference_penalized": hit, "score_effective": F.when(hit, raw * factor).otherwise(raw)})


def diversify(rows: DataFrame, cap: int, top_k: int, order: Sequence[Column], by: Sequence[str] = ("query_id",)) -> DataFrame:
    """At most ``cap`` rows of a paper first, the others behind them; rows without paper are not capped."""
    own = F.row_number().over(Window.partitionBy(*by, "paper_id").orderBy(*order))
    over = F.when(F.coalesce(F.col("paper_id"), F.lit("")) == "", False).otherwise(own > cap)
    return best(rows.withColumn("over", over), by, [F.asc("over"), *order], top_k, "position").drop("over")


def normalised(score: Column, field: Column) -> Column:
    """Scores on one scale from 0 to 1: rank sums times 15, BM25 by a sigmoid at 8, others clipped."""
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return F.when(field == "score_rrf", clip(score * 15)).when(field == "score_bm25", 1 / (1 + F.exp(-0.5 * (score - 8)))).otherwise(clip(score))


def decide(rows: DataFrame, low: float = 0.21, high: float = 0.48, min_chunks: int = 3, enabled: bool = True) -> DataFrame:
    """``query_id, n_chunks, field, evidence_score, decision, signal_quality`` of each query's list.

    The field is the first one that any row of the list has; the score is the mean of the best
    ``min_chunks`` normalised values.
    """
    names = [c for c in SCORE_FIELDS if c in rows.columns]
    over = Window.partitionBy("query_id")
    has = {c: F.max(F.col(c).isNotNull()).over(over) for c in names}
    field = F.lit(None).cast("string")
    value = F.lit(None).cast("double")
    for c in reversed(names):
        field, value = F.when(has[c], c).otherwise(field), F.when(has[c], F.col(c)).otherwise(value)
    seen = rows.select("query_id", "chunk_id", field.alias("field"), value.alias("value"))
    seen = seen.withColumn("value", normalised(F.col("value"), F.col("field")))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("value"), "chunk_id"))
    top = seen.withColumn("n", n)
    used = F.col("n") <= min_chunks if min_chunks > 0 else F.lit(True)
    out = top.groupBy("query_id").agg(F.count("chunk_id").alias("n_chunks"), F.first("field").alias("field"), F.avg(F.when(used, F.col("value"))).alias("s"))
    s = F.round("s", 9)
    bad = F.col("field").isin(*LOW_QUALITY)
    decision = F.when(F.col("n_chunks") == 0, "no_chunks").when(F.lit(not enabled) | F.col("field").isNull() | bad, "confident").when(s < low, "no_evidence").when(s < high, "weak_evidence").otherwise("confident")
    quality = F.when(F.col("n_chunks") == 0, "no_chunks").when(F.lit(not enabled), "disabled").when(F.col("field").isNull(), "missing").when(bad, "low_degraded").otherwise("high")
    return out.select("query_id", "n_chunks", "field", F.round("s", 4).alias("evidence_score"), decision.alias("decision"), quality.alias("signal_quality"))


def select_evidence(rows: DataFrame, max_chunks: int = 4, max_per_paper: int = 2) -> DataFrame:
    """Evidence for an answer from ranked rows with ``query, section, text, position``.

    References go; the score adds lexical overlap, a hint from the section and a trace of the rank;
    at most ``max_per_paper`` of a paper are taken, without filling up behind them.
    """
    rows = rows.where(~T.is_reference(F.col("section")) | T.reference_intent(F.col("query")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("position"))
    names = [c for c in ("score_rerank", "score_rrf", "score_dense", "score") if c in rows.columns]
    rows = rows.withColumns({"rank": rank, "overlap": T.overlap(F.col("query"), F.concat_ws(" ", *[c for c in ("section", "title", "text") if c in rows.columns])), "hint": T.section_hint(F.col("section"))})
    score = F.coalesce(*[F.col(c) for c in names], F.lit(0.0)) + 0.2 * F.col("overlap") + 0.03 * F.col("hint") + 0.001 / F.col("rank")
    rows = rows.withColumn("select_score", F.round(F.round(score, 9), 6))
    order = [F.desc("select_score"), F.asc("rank")]
    own = F.row_number().over(Window.partitionBy("query_id", "paper_id").orderBy(*order))
    free = F.coalesce(F.col("paper_id"), F.lit("")) == ""
    rows = rows.withColumn("own", own).where(free | (F.col("own") <= max_per_paper))
    return best(rows, ["query_id"], order, max_chunks, "selected").drop("own")


def phrase_hits(chunks: DataFrame, phrases: DataFrame) -> DataFrame:
    """``phrase_id, chunk_id, hits``: places where a phrase's tokens follow one another.

    ``phrases`` has ``phrase_id, phrase``; those of a block go to all tasks, which walk each chunk's tokens once
    and compare a phrase only where its first two tokens are.  A phrase without tokens is nowhere.
    """
    asked, found = phrases.select("phrase_id", "phrase").toLocalIterator(), None
    while (block := list(islice(asked, MOST_TEXTS))) or found is None:
        first: dict[tuple[str, ...], list[tuple[int, list[str]]]] = {}
        for r in block:
            if own := T.index_terms(r["phrase"]):
                first.setdefault(tuple(own[:2]), []).append((r["phrase_id"], own))
        shared = chunks.sparkSession.sparkContext.broadcast(first)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            first = shared.value
            single = any(len(k) == 1 for k in first)
            for batch in pieces(batches):
                rows, names = [], batch.column(0).to_pylist()
                for row, text in enumerate(batch.column(1).to_pylist()):
                    tokens, hits = T.index_terms(text), Counter()
                    for i, pair in enumerate(zip(tokens, [*tokens[1:], ""], strict=False)):
                        for phrase, own in (*first.get(pair, ()), *(first.get(pair[:1], ()) if single else ())):
                            hits[phrase] += tokens[i : i + len(own)] == own
                    rows += [(p, names[row], n) for p, n in hits.items() if n]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 3)], ["phrase_id", "chunk_id", "hits"])

        some = spread(chunks.select("chunk_id", "text")).mapInArrow(search, "phrase_id long, chunk_id long, hits long")
        found = some if found is None else found.unionByName(some)
    return found
