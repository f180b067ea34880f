"""A coarse vector index: every point lies in the cell of its nearest centre, and a search reads the cells it probes.

Centres are fitted by spherical k-means to at most ``SAMPLE`` points, those of the smallest hashes; every point is indexed, wherever it
lies.  Cells are folders, so a probe prunes the scan; a crowded cell is many file splits, each of which keeps its own ``top_k``, so no
cell is one task.  Points change by paper (``Versions``).

``probes`` cells a question give most of the best points.  Their number is chosen when the index is built: the least by which ``AIM`` of the exact
rows of ``TRIALS`` points were found; vectors without clusters need many, clustered ones few.  The exact way takes two turns: the probed cells give
each question a score it has for certain, and then only those cells are read whose nearest possible point, by the angle of the
centre less the cell's widest angle, could beat it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import MOST_QUERIES, MOST_SCORES, best
from .topk import TopK
from .versions import Versions

#: Points that centres are fitted to, centres at most, turns of the fit.
SAMPLE, MOST_CELLS, TURNS = 16_384, 1024, 12
#: Points that stand for questions when the number of probes is chosen, rows of each, and the share of these rows that must be found.
TRIALS, TRIAL_ROWS, AIM = 128, 20, 0.95
#: What rounding can add to a cosine.
SLACK = 1e-6

POINTS = "chunk_id long, paper_id string, vector array<float>, near double, cell int"
CENTRES = "cell int, centre array<double>, paper_id string"
WIDTHS = "cell int, least double, paper_id string"
SETTINGS = "probes int, paper_id string"


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def centres_of(rows: np.ndarray, cells: int, seed: int = 0) -> np.ndarray:
    """Unit centres of ``rows``; a cell that lost its points takes the point that is farthest from its own centre."""
    rows = unit(rows)
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(cells, len(rows)), replace=False)]
    for _ in range(TURNS):
        near = rows @ centres.T
        own = near.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        lost = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[lost] = rows[np.argsort(near.max(1), kind="stable")[: len(lost)]]
        centres = unit(sums)
    return centres


class CellIndex:
    """The index in a folder; ``points`` are ``chunk_id, paper_id, vector``, null vectors are left out."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.store = spark, Versions(spark, folder)

    def centres(self) -> np.ndarray:
        rows = self.store.all("centres", CENTRES).orderBy("cell").collect()  # MOST_CELLS at most
        return np.array([r["centre"] for r in rows], float)

    def build(self, points: DataFrame, cells: int | None = None) -> CellIndex:
        """Fits the centres and indexes all points; about the square root of their number is the number of cells."""
        points = points.where("vector is not null")
        sample = points.select("vector", F.xxhash64(F.col("chunk_id").cast("long")).alias("h")).orderBy("h").limit(SAMPLE).select("vector").toArrow()
        rows = matrix(sample.column(0).combine_chunks()) if len(sample) else np.zeros((0, 1))
        cells = cells or min(MOST_CELLS, max(1, int(points.count() ** 0.5)))
        centres = centres_of(rows, cells) if len(rows) else np.zeros((1, 1))
        fitted = self.spark.createDataFrame([(i, c.tolist(), "") for i, c in enumerate(centres)], CENTRES)
        self._commit(points, points.select("paper_id"), centres, fitted)
        self.tune(points.select(F.col("chunk_id").cast("long").alias("query_id"), "vector").orderBy(F.xxhash64(F.col("query_id"))).limit(TRIALS))
        return self

    def tune(self, trials: DataFrame, aim: float = AIM, top_k: int = TRIAL_ROWS) -> int:
        """Chooses and keeps the number of probes by the exact lists of ``trials`` (``query_id, vector``; few)."""
        centres = self.centres()
        asked = {r["query_id"]: r["vector"] for r in trials.collect()}
        exact = self.search(trials, top_k, 1, exact=True).where("query_id <> chunk_id")
        cells = exact.join(self.points().select("chunk_id", "cell"), "chunk_id").select("query_id", "cell").collect()
        places = np.argsort(np.argsort(-(unit(np.array([asked[r["query_id"]] for r in cells], float)) @ centres.T), axis=1, kind="stable"), axis=1, kind="stable") if cells else np.zeros((0, 1), int)
        needed = np.sort([places[i, r["cell"]] for i, r in enumerate(cells)])
        probes = int(needed[int(np.ceil(aim * len(needed))) - 1]) + 1 if len(needed) else 1
        kept = self.spark.createDataFrame([(probes, "")], SETTINGS)
        self.store.commit(self.store.last() + 1, {"settings": (kept, kept.limit(0))})
        return probes

    def probes(self) -> int:
        row = self.store.all("settings", SETTINGS).agg(F.max_by("probes", "gen").alias("probes")).first()
        return row["probes"] or 1

    def sync(self, points: DataFrame, papers: DataFrame) -> None:
        """Papers in ``papers`` have exactly their rows of ``points`` from now on, or none; centres stay."""
        changed = papers.select(F.col("paper_id").cast("string").alias("paper_id")).distinct()
        own = points.where("vector is not null").withColumn("paper_id", F.col("paper_id").cast("string")).join(changed, "paper_id", "left_semi")
        self._commit(own, changed, self.centres(), None)

    def _commit(self, points: DataFrame, owners: DataFrame, centres: np.ndarray, fitted: DataFrame | None) -> None:
        gen = self.store.last() + 1
        placed = self.store.staged(gen, "placed", assigned(points, centres))
        widths = placed.groupBy("cell").agg(F.min("near").alias("least")).select("cell", "least", F.lit("").alias("paper_id"))
        nobody = owners.select(F.col("paper_id").cast("string").alias("paper_id")).limit(0)
        tables = {"cells": (placed, owners), "widths": (widths, nobody)} | ({"centres": (fitted, nobody)} if fitted is not None else {})
        self.store.commit(gen, tables, by={"cells": ["cell"]})

    def points(self) -> DataFrame:
        return self.store.table("cells", POINTS)

    def search(self, queries: DataFrame, top_k: int = 20, probes: int | None = None, exact: bool = False) -> DataFrame:
        """``query_id, chunk_id, score_dense, rank_dense`` by cosine of ``queries`` (``query_id, vector``), in blocks of ``MOST_QUERIES``."""
        centres, probes = self.centres(), probes or self.probes()
        widest = np.full(len(centres), np.pi)
        for r in self.store.all("widths", WIDTHS).groupBy("cell").agg(F.min("least").alias("least")).collect():
            widest[r["cell"]] = np.arccos(np.clip(r["least"] - SLACK, -1, 1))
        asked, found = queries.where("vector is not null").select("query_id", "vector").toLocalIterator(), None
        while (block := list(islice(asked, MOST_QUERIES))) or found is None:
            ids = np.array([r["query_id"] for r in block], np.int64)
            vectors = unit(np.array([r["vector"] for r in block], float)) if block else np.zeros((0, centres.shape[1]))
            near = vectors @ centres.T
            wanted = np.zeros(near.shape, bool)
            np.put_along_axis(wanted, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
            if exact and block:
                first = best(self._read(ids, vectors, wanted, top_k), ["query_id"], [F.desc("score_dense"), F.asc("chunk_id")], top_k)
                floor = {r["query_id"]: r["s"] for r in first.where(F.col("rank") == top_k - 1).select("query_id", F.col("score_dense").alias("s")).collect()}  # a number a question of the block
                sure = np.array([floor.get(q, -2.0) for q in ids.tolist()])
                angle = np.maximum(np.arccos(np.clip(near, -1, 1)) - widest, 0)
                wanted = np.cos(angle) + SLACK >= sure[:, None]
            some = self._read(ids, vectors, wanted, top_k)
            found = some if found is None else found.unionByName(some)
        return best(found, ["query_id"], [F.desc("score_dense"), F.asc("chunk_id")], top_k, "rank_dense")

    def _read(self, ids: np.ndarray, vectors: np.ndarray, wanted: np.ndarray, top_k: int) -> DataFrame:
        """Each task's best points of each question among the cells that are wanted for it."""
        cells = np.flatnonzero(wanted.any(0)).tolist()
        shared = self.spark.sparkContext.broadcast((ids, vectors, wanted))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors, wanted = shared.value
            top = TopK(len(ids), top_k)
            step = max(1, MOST_SCORES // max(len(ids), 1))
            for batch in batches:
                for begin in range(0, batch.num_rows if len(ids) else 0, step):
                    part = batch.slice(begin, step)
                    rows, cell = unit(matrix(part.column(1))), part.column(2).to_numpy()
                    scores = np.full((len(rows), len(ids)), -np.inf)
                    for c in np.unique(cell).tolist():
                        at, own = np.flatnonzero(cell == c), np.flatnonzero(wanted[:, c])
                        scores[np.ix_(at, own)] = np.round(rows[at] @ vectors[own].T, 9)
                    top.offer(scores, part.column(0).to_numpy())
            yield top.batch(ids, ["query_id", "chunk_id", "score_dense"])

        rows = self.points().where(F.col("cell").isin(cells)).select("chunk_id", "vector", "cell")
        return rows.mapInArrow(search, "query_id long, chunk_id long, score_dense double")


def assigned(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """``POINTS``: each point with its nearest centre (of equal ones the first) and the cosine to it."""
    shared = points.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = unit(matrix(batch.column(2))) @ shared.value.T
                own = near.argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near[np.arange(len(own)), own]), pa.array(own.astype(np.int32))], ["chunk_id", "paper_id", "vector", "near", "cell"])

    picked = points.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("paper_id").cast("string").alias("paper_id"), F.col("vector").cast("array<float>").alias("vector"))
    return picked.mapInArrow(place, POINTS)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact lists' rows that were found."""
    hit = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hit.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0)).alias("r")).first()["r"]
