"""A kept mirror of segmented chunks for the sparse leg, maintained by paper."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def rows(chunks: DataFrame) -> DataFrame:
    """``chunk_id, paper_id, text`` with the text as its index terms, so that searches needn't segment it; null texts are empty.

    Terms are their own terms, so ``retrieval.bm25`` gives the same rows for the mirror as for the chunks.
    """
    terms = F.array_join(T.index_tokens(F.coalesce("text", F.lit(""))), " ")
    return chunks.select("chunk_id", "paper_id", terms.alias("text"))


def sync(index: DataFrame, chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """The mirror after the papers in ``papers`` (``paper_id``) were ingested anew or deleted; only their chunks are segmented."""
    changed = papers.select("paper_id").distinct()
    fresh = rows(chunks.join(changed, "paper_id", "left_semi"))
    return index.join(changed, "paper_id", "left_anti").select("chunk_id", "paper_id", "text").unionByName(fresh)


def stale(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row ``indexed, chunks, stale``: numbers that differ call for a full rebuild."""
    n = chunks.agg(F.count("*").alias("chunks"))
    return index.agg(F.count("*").alias("indexed")).join(F.broadcast(n)).select("indexed", "chunks", (F.col("indexed") != F.col("chunks")).alias("stale"))
