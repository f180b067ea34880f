"""One retrieval round for a batch of questions: each becomes variants, each variant is asked in all modalities that the question names.

The fan-out is a relation ``question x variant x modality``.  Its dense specs meet the corpus in one scan, whatever their number in a
block; the sparse leg runs once a different text, as a modality only filters its list.  Each spec's two lists are fused, the
specs' lists are pooled by question, and penalties, the window, the reranker and the quota work on the pool.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import models
from ..functions import text as T
from . import retrieval as R
from .concepts import topical_variants

log = logging.getLogger(__name__)

#: Variants and modalities of a question that a spec's number has room for.
VARIANTS, MODALITIES = 1024, 4
#: How a question names an original paper, and the number of local variants.
ORIGINAL = (
    r"(?i)\b(?:the\s+)?(?:original|first|earliest)\s+([A-Za-z][A-Za-z0-9-]{1,20})(?:\s+(?:paper|work|model))?",
    r"(?:最初|最早|原始|最开始)(?:的)?\s*([A-Za-z][A-Za-z0-9-]{1,20})",
    r"([A-Za-z][A-Za-z0-9-]{1,20})\s*的(?:最初|最早|原始|原)(?:的)?(?:论文|工作|模型)",
)
LOCAL_VARIANTS = 5
NO_TEXTS = "array<string>"


@dataclass(frozen=True)
class Round:
    """Sizes of a round: rows of each leg, rows wanted, the fusion's constant, the penalty of references, rows of a paper."""

    pool: int = 20
    top_k: int = 10
    rrf_k: int = 60
    penalty: float = 0.15
    per_paper: int = 50


def original_aliases(question: Column) -> Column:
    """Upper-case names X of "the original X paper", in English and two Chinese forms."""
    found = [F.transform(F.regexp_extract_all(question, F.lit(p), F.lit(1)), F.upper) for p in ORIGINAL]
    return F.array_distinct(F.concat(*found))


def alias_variants(questions: DataFrame, papers: DataFrame) -> DataFrame:
    """``query_id, alias_variants``: of each alias in a question the title of the earliest paper whose title has it, alone and named as the original.

    ``papers`` has ``title, year``.  Aliases of titles are their acronyms; they meet by equality.
    """
    named = questions.select("query_id", F.posexplode(original_aliases(F.col("query"))).alias("place", "alias"))
    titles = papers.where("title is not null").select("title", F.coalesce("year", F.lit(9999)).alias("year"), F.explode(T.title_acronyms(F.col("title"))).alias("alias"))
    first = titles.groupBy("alias").agg(F.min(F.struct("year", "title")).alias("first"))
    met = named.join(first, "alias").select("query_id", "place", F.array("first.title", F.concat_ws(" original paper ", "alias", "first.title")).alias("texts"))
    return met.groupBy("query_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "texts"))), lambda x: x["texts"])).alias("alias_variants"))


def rewrites(questions: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """``query_id, query, dense_queries, bm25_query, modalities`` of ``questions`` (``query_id, query``).

    A column ``reply`` may hold a model's JSON (``variants``, ``keywords``, ``hyde``), ``hints`` and ``hint_terms`` what concepts suggest.  A reply
    that cannot be read leaves the local variants: topics, and originals among ``papers``.
    """
    none = F.array().cast(NO_TEXTS)
    has = lambda c, kind: F.col(c) if c in questions.columns else F.lit(None).cast(kind)
    rows = questions.join(alias_variants(questions, papers), "query_id", "left") if papers is not None else questions.withColumn("alias_variants", none)
    said = models.reply_object(has("reply", "string"), "variants array<string>, keywords string, hyde string")
    local = F.slice(T.merged_variants(topical_variants(F.col("query")), F.coalesce("alias_variants", none), most=VARIANTS), 1, LOCAL_VARIANTS)
    hyde = F.when(F.coalesce(said["hyde"], F.lit("")) != "", F.array(said["hyde"])).otherwise(none)
    dense = T.merged_variants(F.array("query"), F.coalesce(said["variants"], none), local, F.coalesce(has("hints", NO_TEXTS), none), hyde, most=VARIANTS)
    keywords = F.concat_ws(" ", F.coalesce(F.when(said["keywords"] != "", said["keywords"]), F.col("query")), F.when(has("hint_terms", "string") != "", has("hint_terms", "string")))
    return rows.select("query_id", "query", dense.alias("dense_queries"), keywords.alias("bm25_query"), T.modalities(F.col("query")).alias("modalities"))


def specs(rewritten: DataFrame) -> DataFrame:
    """``spec_id, query_id, variant, modality, dense_query, sparse_query``; the modality is null where all are asked.

    A spec's number orders the specs of a question: variants first, in each all modalities, then the named ones.
    """
    all_ = F.concat(F.array(F.lit(None).cast("string")), F.coalesce("modalities", F.array().cast(NO_TEXTS)))
    wide = rewritten.select("query_id", F.posexplode("dense_queries").alias("variant", "dense_query"), "bm25_query", all_.alias("modalities"))
    full = wide.select("*", F.posexplode("modalities").alias("place", "modality"))
    room = F.when((F.col("variant") >= VARIANTS) | (F.col("place") >= MODALITIES), F.raise_error(F.lit("too many variants or modalities")).cast("long")).otherwise(0)
    number = (F.col("query_id") * VARIANTS + F.col("variant")) * MODALITIES + F.col("place") + room
    sparse = F.coalesce(F.when(F.col("bm25_query") != "", F.col("bm25_query")), F.col("dense_query"))
    return full.select(number.alias("spec_id"), "query_id", "variant", "modality", "dense_query", sparse.alias("sparse_query"))


#: What a search server or an index raises when it cannot be reached; anything else is a fault of the leg.
UNAVAILABLE = (ConnectionError, TimeoutError)


def tried(name: str, leg: Callable[[], DataFrame], unavailable: tuple[type[Exception], ...] = UNAVAILABLE) -> DataFrame | None:
    """A leg's rows, or None if it failed with one of ``unavailable``, which is logged; any other failure is raised.

    Rows are kept where a failure may be let pass, as it must be seen before the lists are fused.
    """
    if not unavailable:
        return leg()
    try:
        rows = leg().persist()
        rows.count()
    except unavailable as problem:
        log.warning("%s leg failed: %s", name, problem)
        return None
    return rows


def search(asked: DataFrame, chunks: DataFrame, dense: Callable[[DataFrame], DataFrame], sparse: Callable[[DataFrame], DataFrame], sizes: Round = Round(), unavailable: tuple[type[Exception], ...] = UNAVAILABLE) -> DataFrame:
    """``spec_id, chunk_id, position, score_rrf, score_dense, score_bm25, lost_leg`` of the specs ``asked``: both legs fused, twice ``top_k`` rows each.

    ``dense`` gets ``spec_id, query, modality`` and gives ``query_id`` (the spec's number)``, chunk_id, score_dense, rank_dense`` of the modality's chunks;
    ``sparse`` gets ``query_id, query`` (a number for each different text) and gives ``query_id, chunk_id, score_bm25, rank_bm25`` of all chunks.  One of them may
    fail with an error of ``unavailable``; the rows of the other then say in ``lost_leg`` which one it was.
    """
    texts = asked.groupBy("sparse_query").agg(F.min("spec_id").alias("text_id"))
    by_vector = tried("dense", lambda: dense(asked.select("spec_id", F.col("dense_query").alias("query"), "modality")), unavailable)
    by_term = tried("sparse", lambda: sparse(texts.select(F.col("text_id").alias("query_id"), F.col("sparse_query").alias("query"))), unavailable)
    if by_vector is None and by_term is None:
        raise RuntimeError("both dense and sparse retrieval are unavailable")
    legs = []
    if by_vector is not None:
        legs.append((by_vector.select("query_id", "chunk_id", "score_dense", "rank_dense"), "rank_dense"))
    if by_term is not None:
        kinds = chunks.select("chunk_id", F.col("modality").alias("kind"))
        hits = by_term.withColumnRenamed("query_id", "text_id").join(kinds, "chunk_id")
        spread = asked.join(texts, "sparse_query").select("spec_id", "text_id", "modality").join(hits, "text_id").where("modality is null or modality = kind")
        ranked = R.best(spread.drop("text_id", "kind", "modality").withColumnRenamed("rank_bm25", "listed"), ["spec_id"], [F.asc("listed")], sizes.pool, "rank_bm25")
        legs.append((ranked.select(F.col("spec_id").alias("query_id"), "chunk_id", "score_bm25", "rank_bm25"), "rank_bm25"))
    fused = R.fused_top(R.rrf(legs, sizes.rrf_k, ("score_dense", "score_bm25")), 2 * sizes.top_k)
    lost = "dense" if by_vector is None else "sparse" if by_term is None else None
    return fused.withColumnRenamed("query_id", "spec_id").withColumn("lost_leg", F.lit(lost).cast("string"))


def pooled(found: DataFrame, asked: DataFrame) -> DataFrame:
    """Of each chunk of a question the row of the spec that scores it highest, the first of equals; ``seq`` is where the chunk was seen first."""
    rows = found.join(asked.select("spec_id", "query_id", "variant", F.col("modality").alias("asked_modality")), "spec_id")
    order = F.struct("spec_id", "position")
    kept = [c for c in rows.columns if c not in ("query_id", "chunk_id")]
    best = F.max_by(F.struct(*kept), F.struct("score_rrf", -F.col("spec_id"), -F.col("position")))
    out = rows.groupBy("query_id", "chunk_id").agg(F.min(order).alias("seq"), best.alias("row"))
    return out.select("query_id", "chunk_id", "seq", *[F.col(f"row.{c}").alias(c) for c in kept])


def retrieve(rewritten: DataFrame, chunks: DataFrame, dense: Callable[[DataFrame], DataFrame], sparse: Callable[[DataFrame], DataFrame], sizes: Round = Round(), reranker: Callable[[Column, Column], Column] | None = None, unavailable: tuple[type[Exception], ...] = ()) -> DataFrame:
    """Ranked rows of each question with the chunk's columns, ``position``, scores and the spec that found them.

    ``chunks`` has ``chunk_id, paper_id, section, modality, text``.  Without ``reranker`` the window keeps the order of the pool.
    A leg that fails is an error, unless by one of ``unavailable``; then ``lost_leg`` names it.
    """
    asked = specs(rewritten).persist()
    rows = pooled(search(asked, chunks, dense, sparse, sizes, unavailable), asked).drop("position")
    rows = rows.join(chunks, "chunk_id").join(rewritten.select("query_id", "query"), "query_id")
    intent = T.reference_intent(F.col("query"))
    window = R.best(R.penalise(rows, sizes.penalty, intent), ["query_id"], [F.desc("score_effective"), F.asc("seq")], 3 * sizes.top_k, "place")
    ranked = R.penalise(models.rerank(window, reranker), sizes.penalty, intent) if reranker else window
    return R.diversify(ranked, sizes.per_paper, sizes.top_k, [F.desc("score_effective"), F.asc("place")])
