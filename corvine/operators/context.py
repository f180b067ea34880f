"""Concepts that belong to questions: by their names and labels in the question, by shared papers and evidence, and by nearness where these give too few.

Frames: ``entries`` (``entry_id, name_norm, merged_into``), ``labels`` (``entry_id, label_norm``), ``papers`` (``entry_id, paper_id``), ``evidence``
(``entry_id, chunk_id``); ``questions`` (``query_id, question_norm``).  Norms are ``concepts.label_norm``; empty ones are nowhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import best
from .store import resolve_redirects

#: Lengths of the pieces by which labels meet questions: a label is looked up by the longest that it has room for.
PIECES = (1, 2, 3, 4, 8)
#: Points of names, labels, shared papers, nearness, and of evidence, papers and labels where evidence is known.
NAME, LABEL, PAPERS, NEAR = 100, 90, 50, 25
BY_EVIDENCE, BY_PAPERS, BY_LABEL = 300, 200, 100
#: Rows of evidence a task is planned for.
TASK_ROWS = 1 << 18
SHORTEST_LABEL, MOST_PAPERS, MOST_DIRECT, MOST_SHARED, MOST_ENTRIES = 3, 3, 10, 5, 3


def piece_size(text: Column) -> Column:
    out = F.lit(None).cast("int")
    for size in PIECES:
        out = F.when(F.length(text) >= size, size).otherwise(out)
    return out


def contained(questions: DataFrame, labels: DataFrame, text: str = "question_norm", label: str = "label_norm") -> DataFrame:
    """``query_id`` and the labels' rows where the label is a part of the question.

    A label meets a question by its first piece, an equality, and only then is compared at that place; so no question meets all labels.
    Labels are made distinct before they meet: a row comes once a text of its question, and no task holds the pairs.
    """
    dealt = labels.where(F.coalesce(F.length(label), F.lit(0)) > 0).repartition(labels.sparkSession.sparkContext.defaultParallelism, "entry_id").distinct()
    keyed = dealt.withColumn("piece", F.left(label, piece_size(F.col(label))))
    size = F.explode(F.array(*map(F.lit, PIECES))).alias("size")
    sized = questions.select("query_id", F.col(text).alias("whole"), size).where(F.length("whole") >= F.col("size"))
    placed = sized.select("query_id", "whole", "size", F.explode(F.sequence(F.lit(1), F.length("whole") - F.col("size") + 1)).alias("at"))
    pieces = placed.select("query_id", "whole", F.substring("whole", F.col("at"), F.col("size")).alias("piece")).distinct()
    return pieces.join(keyed, "piece").where(F.contains(F.col("whole"), F.col(label))).drop("piece", "whole")


def filled(scored: DataFrame, near: DataFrame | None, most: int, only_empty: bool) -> DataFrame:
    """``query_id, entry_id, score, rank``: scored entries, then near ones (``query_id, entry_id, place``) with ``NEAR`` points.

    ``only_empty``: the nearest one, and only for questions without any; else as many as are missing of ``most``.
    """
    # a question with fewer than ``most`` has all its scored entries among the best
    scored = best(scored, ["query_id"], [F.desc("score"), F.asc("entry_id")], most)
    if near is None:
        return scored
    scored = scored.drop("rank")
    have = scored.groupBy("query_id").agg(F.count("*").alias("have"))
    free = near.join(scored.select("query_id", "entry_id"), ["query_id", "entry_id"], "left_anti").join(have, "query_id", "left")
    room = F.when(F.coalesce("have", F.lit(0)) > 0, 0).otherwise(1) if only_empty else F.lit(most) - F.coalesce("have", F.lit(0))
    chosen = best(free.withColumn("room", room).where("room > 0"), ["query_id"], [F.asc("place"), F.asc("entry_id")], most, "nth").where("nth < room")
    return best(scored.unionByName(chosen.select("query_id", "entry_id", F.lit(NEAR).alias("score"))), ["query_id"], [F.desc("score"), F.asc("entry_id")], most)


def question_context(questions: DataFrame, entries: DataFrame, labels: DataFrame, papers: DataFrame, scope: DataFrame | None = None, near: DataFrame | None = None, most: int = MOST_ENTRIES) -> DataFrame:
    """Entries of each question: name in it, else a label of three characters or more, and papers of its ``scope`` (``query_id, paper_id``)."""
    live = entries.where("merged_into is null")
    names = contained(questions, live.select("entry_id", F.col("name_norm").alias("label_norm"))).select("query_id", "entry_id", F.lit(NAME).alias("by_name")).distinct()
    own = labels.where(F.length("label_norm") >= SHORTEST_LABEL).join(live.select("entry_id"), "entry_id", "left_semi")
    marks = contained(questions, own.select("entry_id", "label_norm")).select("query_id", "entry_id").distinct().withColumn("by_label", F.lit(LABEL))
    rows = names.join(marks, ["query_id", "entry_id"], "full_outer").withColumn("score", F.coalesce("by_name", "by_label")).select("query_id", "entry_id", "score")
    if scope is not None:
        known = papers.join(live.select("entry_id"), "entry_id", "left_semi").distinct()
        shared = scope.distinct().join(known, "paper_id").groupBy("query_id", "entry_id").agg(F.count("*").alias("n"))
        rows = rows.unionByName(shared.select("query_id", "entry_id", (PAPERS + F.least("n", F.lit(MOST_PAPERS))).cast("int").alias("score")))
    scored = rows.groupBy("query_id", "entry_id").agg(F.sum("score").cast("int").alias("score"))
    alive = near.join(live.select("entry_id"), "entry_id", "left_semi") if near is not None else None
    return filled(scored, alive, most, True)


def evidence_context(questions: DataFrame, hits: DataFrame, entries: DataFrame, labels: DataFrame, papers: DataFrame, evidence: DataFrame, near: DataFrame | None = None, most: int = MOST_ENTRIES) -> DataFrame:
    """Entries of questions with ``hits`` (``query_id, chunk_id, paper_id``): tiers by shared evidence, shared papers, labels.

    Merged entries have no say; where a near one is merged, its target stands for it.

    What hits share with entries is counted by pairs of question and entry, and no chunk's whole list is built.  The pairs are many more
    than the rows, so they are dealt to as many tasks as the evidence's rows ask for, and no task counts more of them as the input grows.
    """
    target = resolve_redirects(entries)
    tasks = max(evidence.sparkSession.sparkContext.defaultParallelism, math.ceil(evidence.count() / TASK_ROWS))
    chunks = hits.where("chunk_id is not null").select("query_id", "chunk_id").repartition(tasks, "chunk_id").distinct()
    shown = hits.where("paper_id is not null").select("query_id", "paper_id").distinct()
    with_hits = questions.join(hits.select("query_id").distinct(), "query_id", "left_semi")
    names = entries.select("entry_id", F.col("name_norm").alias("label_norm")).unionByName(labels.select("entry_id", "label_norm"))
    pair = lambda frame, kind: frame.select("query_id", "entry_id", *[F.lit(int(c == kind)).cast("long").alias(c) for c in ("direct", "paper", "named")])
    pairs = pair(chunks.join(evidence.select("entry_id", "chunk_id").repartition(tasks, "chunk_id").distinct(), "chunk_id"), "direct")
    pairs = pairs.unionByName(pair(shown.join(papers.select("entry_id", "paper_id").repartition(tasks, "entry_id").distinct(), "paper_id"), "paper"))
    pairs = pairs.unionByName(pair(contained(with_hits, names), "named"))
    own = pairs.repartition(tasks, "query_id", "entry_id").groupBy("query_id", "entry_id").agg(*[F.sum(c).alias(c) for c in ("direct", "paper")])
    rows = own.join(entries.where("merged_into is null").select("entry_id"), "entry_id", "left_semi")
    tier = F.when(F.col("direct") > 0, BY_EVIDENCE).when(F.col("paper") > 0, BY_PAPERS).otherwise(BY_LABEL)
    score = (tier + F.least("direct", F.lit(MOST_DIRECT)) + F.least("paper", F.lit(MOST_SHARED))).cast("int")
    scored = rows.select("query_id", "entry_id", score.alias("score"))
    followed = None
    if near is not None:
        followed = near.join(with_hits.select("query_id"), "query_id", "left_semi").join(target, "entry_id").groupBy("query_id", F.col("target_id").alias("entry_id")).agg(F.min("place").alias("place"))
    return filled(scored, followed, most, False)
