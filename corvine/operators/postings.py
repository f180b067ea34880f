"""A kept inverted index: posting blocks by term with document frequencies, lengths and score bounds, changed by paper.

The index is a folder of tables to which every commit adds a generation.  Chunks are dealt to shards by their ids, so that no
term and no paper is a hot key.  ``docs`` keeps each chunk's terms and counts; ``postings`` has, by shard and term, blocks of up to ``BLOCK`` chunks
with their counts and lengths, the number of chunks and the highest count and least length in the block.  A change of a paper adds the
postings of its new chunks with ``sign`` 1 and those of its old chunks, taken from ``docs``, with ``sign`` -1, so its cost is that
of the paper's chunks; what is not in either is not touched.  ``papers`` says which generation last spoke of a paper, and ``totals``, written
last, makes a generation count: one that failed before is overwritten by the next.

``search`` reads only rows of asked terms (pushed to the scan up to ``PUSHED`` terms, else by a broadcast of the terms), deals them by shard, and
in each shard scores term by term, the highest bounds first.  As soon as the terms that are left cannot lift an unseen chunk to the
``top_k``-th score, only candidates are looked up, and blocks without one are skipped.  Scores are those of ``retrieval.bm25``.

Null texts are empty; a question without terms or without a known term finds nothing; chunk ids are numbers and unique, and a paper is replaced as a whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.batches import pieces
from ..functions.stemming import analyse
from .retrieval import BM25, MOST_TEXTS, best
from .topk import TopK
from .versions import CODEC

#: Ways to terms: words and CJK pairs as they are, or folded and stemmed.
ANALYSERS = {"plain": T.index_terms, "porter": analyse}
#: Chunks of a block, chunks and characters of a shard that are aimed at, terms that are pushed to the scan one by one.
BLOCK, SHARD_ROWS, SHARD_CHARS, PUSHED = 256, 1 << 12, 1 << 24, 64
#: Postings that a task inverts at a time; a shard that has more gets several runs of blocks.
MOST_POSTINGS = 1 << 19
#: What rounding can add to a sum of bounds.
SLACK = 1e-6

DOCS = "shard int, chunk_id long, paper_id string, sign int, size int, terms array<string>, counts array<int>"
POSTINGS = "shard int, term string, sign int, n int, most int, least int, ids array<long>, counts array<int>, sizes array<int>, papers array<string>"


def documents(chunks: DataFrame, analyser: str, shards: int) -> DataFrame:
    """``DOCS`` of chunks: terms and how often each comes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_of = ANALYSERS[analyser]
        for batch in pieces(batches):
            sizes, terms, counts, edges = [], [], [], [0]
            for text in batch.column(3).to_pylist():
                own = Counter(found := terms_of(text))
                sizes.append(len(found))
                terms += own
                counts += own.values()
                edges.append(len(terms))
            at = pa.array(edges, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(v, k)) for v, k in ((terms, pa.string()), (counts, pa.int32()))]
            ones = pa.array(np.ones(batch.num_rows, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], ones, pa.array(sizes, pa.int32()), *lists], [f.split()[0] for f in DOCS.split(", ")])

    shard = F.pmod(F.xxhash64(F.col("chunk_id").cast("long")), F.lit(shards)).cast("int").alias("shard")
    picked = chunks.select(shard, F.col("chunk_id").cast("long").alias("chunk_id"), F.col("paper_id").cast("string").alias("paper_id"), F.col("text"))
    return picked.mapInArrow(count, DOCS).sortWithinPartitions("paper_id")


def by_shard(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each shard as one table; rows come sorted by shard.  With ``most``, of rows with ``terms``, as several tables of about so many terms."""
    held: list[pa.RecordBatch] = []
    terms = 0
    for batch in batches if most is None else pieces(batches):
        shards = batch.column(0).to_numpy()
        edges = np.r_[0, np.flatnonzero(np.diff(shards)) + 1, len(shards)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if held and b > a and (held[0].column(0)[0].as_py() != shards[a] or (most is not None and terms >= most)):
                yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)
                held, terms = [], 0
            if b > a:
                held.append(batch.slice(a, b - a))
                terms += 0 if most is None else len(held[-1].column("terms").flatten())
    if held:
        yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)


def inverted(docs: DataFrame, most: int | None = None) -> DataFrame:
    """``POSTINGS`` of ``DOCS``, sorted by term in each shard; ``most`` postings at a time, ``MOST_POSTINGS`` unless given.

    Terms, which have no blanks, move as one string a chunk: in a shuffle's rows an array takes eight bytes more for each and fills each up to eight.
    """
    most = most or MOST_POSTINGS

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, table in by_shard(batches, most):
            lists = table.column("terms").combine_chunks()
            if not len(flat := lists.flatten()):
                continue
            times = np.diff(lists.offsets.to_numpy())
            coded = flat.dictionary_encode()
            names = coded.dictionary.to_numpy(zero_copy_only=False)
            place = np.empty(len(names), np.int64)
            place[np.argsort(names, kind="stable")] = np.arange(len(names))
            term, row = place[coded.indices.to_numpy()], np.repeat(np.arange(table.num_rows), times)
            sign, ids, size = (table.column(c).to_numpy() for c in ("sign", "chunk_id", "size"))
            count = table.column("counts").combine_chunks().flatten().to_numpy()
            order = np.lexsort((ids[row], sign[row], term))
            term, row, count = term[order], row[order], count[order]
            head = np.r_[True, (np.diff(term) != 0) | (np.diff(sign[row]) != 0)]
            first = np.flatnonzero(head)
            nth = np.arange(len(term)) - np.repeat(first, np.diff(np.r_[first, len(term)]))
            edges = np.r_[np.flatnonzero(nth % BLOCK == 0), len(term)]
            at, sizes = pa.array(edges.astype(np.int32)), size[row]
            listed = lambda v, k, at=at: pa.ListArray.from_arrays(at, pa.array(v, k))
            begin = edges[:-1]
            columns = [
                pa.array(np.full(len(begin), shard, np.int32)), pa.array(np.sort(names)[term[begin]], pa.string()), pa.array(sign[row[begin]].astype(np.int32)), pa.array(np.diff(edges).astype(np.int32)),
                pa.array(np.maximum.reduceat(count, begin).astype(np.int32)), pa.array(np.minimum.reduceat(sizes, begin).astype(np.int32)),
                listed(ids[row], pa.int64()), listed(count, pa.int32()), listed(sizes, pa.int32()), pa.ListArray.from_arrays(at, table.column("paper_id").combine_chunks().take(pa.array(row))),
            ]
            whole = pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in POSTINGS.split(", ")])
            for a in range(0, whole.num_rows, 4096):
                yield whole.slice(a, 4096)

    names = [f.split()[0] for f in DOCS.split(", ")]
    dealt = docs.select(*names).withColumn("terms", F.array_join("terms", " ")).repartition("shard").sortWithinPartitions("shard")
    terms = F.when(F.col("terms") == "", F.array().cast("array<string>")).otherwise(F.split("terms", " "))
    return dealt.withColumn("terms", terms).mapInArrow(invert, POSTINGS).sortWithinPartitions("shard", "term")


class Index:
    """The tables of one folder.  One writer at a time; readers see the generations that are complete."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        """Rows of the complete generations."""
        made = self.spark.read.parquet(f"{self.folder}/{name}")
        return made if name == "totals" else made.where(F.col("gen") <= self.last())

    def last(self) -> int:
        """The newest complete generation; a folder without one is an error."""
        return self.spark.read.parquet(f"{self.folder}/totals").agg(F.max("gen")).first()[0]

    def exists(self) -> bool:
        try:
            return self.last() is not None
        except AnalysisException as absent:
            if absent.getCondition() != "PATH_NOT_FOUND":
                raise
            return False

    def mark(self) -> int:
        """What the newest generation says of the store it follows; -1 where none said anything."""
        return self.spark.read.parquet(f"{self.folder}/totals").agg(F.max("mark")).first()[0]

    def settings(self) -> tuple[str, int]:
        row = self.spark.read.parquet(f"{self.folder}/totals").where("gen = 0").first()
        return row["analyser"], row["shards"]

    def totals(self) -> tuple[int, int]:
        """Chunks and terms of all chunks."""
        row = self.table("totals").agg(F.sum("chunks").alias("chunks"), F.sum("terms").alias("terms")).first()
        return row["chunks"] or 0, row["terms"] or 0

    def commit(self, gen: int, docs: DataFrame, papers: DataFrame, analyser: str, shards: int, mark: int = -1) -> dict[str, int]:
        at = lambda name: f"{self.folder}/{name}/gen={gen}"
        docs.write.mode("overwrite").option("compression", CODEC).parquet(at("docs"))
        papers.select(F.col("paper_id").cast("string").alias("paper_id")).distinct().write.mode("overwrite").parquet(at("papers"))
        kept = self.spark.read.parquet(at("docs"))
        inverted(kept).write.mode("overwrite").option("compression", CODEC).parquet(at("postings"))
        one = lambda c, s: F.coalesce(F.sum(F.when(F.col("sign") == s, c)), F.lit(0))
        row = kept.agg(one(F.lit(1), 1).alias("added"), one(F.lit(1), -1).alias("removed"), one(F.col("size").cast("long"), 1).alias("more"), one(F.col("size").cast("long"), -1).alias("less")).first()
        done = self.spark.createDataFrame([(row["added"] - row["removed"], row["more"] - row["less"], analyser, shards, mark)], "chunks long, terms long, analyser string, shards int, mark int")
        done.coalesce(1).write.mode("overwrite").parquet(at("totals"))
        return {"added": row["added"], "removed": row["removed"]}

    def build(self, chunks: DataFrame, analyser: str = "porter", shards: int | None = None, mark: int = -1) -> Index:
        """Generation 0 of all chunks; the number of shards stays.  It follows from the number and the characters of chunks unless given.

        ``mark`` is as in ``sync``.
        """
        shards = shards or self.shards_for(chunks)
        self.commit(0, documents(chunks, analyser, shards), chunks.select("paper_id"), analyser, shards, mark)
        return self

    def shards_for(self, chunks: DataFrame) -> int:
        rows, chars = chunks.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
        return max(1, -(-rows // SHARD_ROWS), -(-chars // SHARD_CHARS), self.spark.sparkContext.defaultParallelism)

    def sync(self, chunks: DataFrame, papers: DataFrame, mark: int = -1, only: bool = False) -> dict[str, int]:
        """Papers in ``papers`` (``paper_id``) have exactly their rows of ``chunks`` from now on, or none; gives chunks added and removed.

        ``mark`` is kept for whoever has to know up to where the index has followed a store.  With ``only``, ``chunks`` has rows of these papers
        only, and texts are not shuffled to find them.
        """
        gen, (analyser, shards) = self.last() + 1, self.settings()
        changed = papers.select(F.col("paper_id").cast("string").alias("paper_id")).distinct()
        spoke = self.table("papers").join(changed, "paper_id", "left_semi").groupBy("paper_id").agg(F.max("gen").alias("gen"))
        old = self.table("docs").where("sign = 1").join(spoke, ["paper_id", "gen"], "left_semi")
        names = [f.split()[0] for f in DOCS.split(", ")]
        chunks = chunks.withColumn("paper_id", F.col("paper_id").cast("string"))
        fresh = documents(chunks if only else chunks.join(changed, "paper_id", "left_semi"), analyser, shards)
        return self.commit(gen, fresh.select(*names).unionByName(old.withColumn("sign", F.lit(-1)).select(*names)), changed, analyser, shards, mark)

    def chunks(self) -> DataFrame:
        """``chunk_id, paper_id, size`` of the chunks that are in the index now."""
        spoke = self.table("papers").groupBy("paper_id").agg(F.max("gen").alias("gen"))
        return self.table("docs").where("sign = 1").join(spoke, ["paper_id", "gen"], "left_semi").select("chunk_id", "paper_id", "size")

    def compact(self, folder: str) -> Index:
        """An index of one generation in another folder, from the kept terms; no text is read."""
        analyser, shards = self.settings()
        names = [f.split()[0] for f in DOCS.split(", ")]
        spoke = self.table("papers").groupBy("paper_id").agg(F.max("gen").alias("gen"))
        live = self.table("docs").where("sign = 1").join(spoke, ["paper_id", "gen"], "left_semi").select(*names)
        new = Index(self.spark, folder)
        new.commit(0, live, live.select("paper_id"), analyser, shards)
        return new

    def frequencies(self, only: Column | None = None) -> DataFrame:
        """``term, df`` of the terms in the index now."""
        rows = self.table("postings").select("term", (F.col("sign") * F.col("n")).alias("n"))
        return (rows if only is None else rows.where(only)).groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")

    def search(self, queries: DataFrame, variant: str = "fts", top_k: int = 20, paper_ids: DataFrame | None = None) -> DataFrame:
        """``query_id, chunk_id, paper_id, score_bm25, rank_bm25`` of ``queries`` (``query_id, query``), in blocks of ``MOST_TEXTS``.

        A paper filter (rows of ``paper_id``) leaves the statistics as they are.
        """
        (n, size), terms_of = self.totals(), ANALYSERS[self.settings()[0]]
        middle = 0.0
        if variant == "okapi":
            middle = self.frequencies().agg(F.avg(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))).first()[0] or 0.0
        asked, found = queries.select("query_id", "query").toLocalIterator(), None
        while (block := list(islice(asked, MOST_TEXTS))) or found is None:
            some = self._block([(r["query_id"], Counter(terms_of(r["query"]))) for r in block], n, size / n if n else 0.0, middle, variant, top_k, paper_ids)
            found = some if found is None else found.unionByName(some)
        return best(found, ["query_id"], [F.desc("score_bm25"), F.asc("chunk_id")], top_k, "rank_bm25").select("query_id", "chunk_id", "paper_id", "score_bm25", "rank_bm25")

    def _block(self, asked: list[tuple[int, Counter]], n: int, mean: float, middle: float, variant: str, top_k: int, paper_ids: DataFrame | None) -> DataFrame:
        k1, b = BM25[variant]
        wanted = sorted({t for _, own in asked for t in own})
        only = reduce(lambda x, t: x | (F.col("term") == t), wanted, F.lit(False)) if len(wanted) <= PUSHED else None
        names = self.spark.createDataFrame([(t,) for t in wanted], "term string")
        picked = lambda frame: frame.where(only) if only is not None else frame.join(F.broadcast(names), "term", "left_semi")
        known = {}
        for r in picked(self.frequencies(only)).toLocalIterator():
            idf = float(np.log((n - r["df"] + 0.5) / (r["df"] + 0.5)))
            known[r["term"]] = (0.25 * middle if idf < 0 else idf) if variant == "okapi" else max(idf, 1e-6)
        weights = [(q, sorted((t, times * known[t] * (k1 + 1)) for t, times in own.items() if t in known)) for q, own in asked]
        shared = self.spark.sparkContext.broadcast(weights)
        rows = picked(self.table("postings"))
        if paper_ids is not None:
            papers = paper_ids.select(F.col("paper_id").cast("string").alias("paper_id")).distinct()
            names_ = F.broadcast(papers.agg(F.collect_list("paper_id").alias("allowed")))
            rows = rows.join(names_).withColumn("allowed", F.transform("papers", lambda p: F.array_contains("allowed", p)))
        else:
            rows = rows.withColumn("allowed", F.lit(None).cast("array<boolean>"))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            top, papers = TopK(len(asked), top_k), {}
            for _, table in by_shard(batches):
                shard = Shard(table, k1, b, mean)
                for q, (_, own) in enumerate(asked):
                    ids, scores = shard.scores(own, top.floor[q], top_k)
                    if len(ids):
                        top.offer_one(q, scores, ids)
                papers |= shard.papers(np.unique(top.row))
                papers = {i: papers[i] for i in set(top.row.tolist())}
            names = np.array([q for q, _ in asked], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names[top.query], pa.int64()), pa.array(top.row, pa.int64()), pa.array([papers[i] for i in top.row.tolist()], pa.string()), pa.array(top.score)], ["query_id", "chunk_id", "paper_id", "score_bm25"])

        dealt = rows.select("shard", "term", "gen", "sign", "n", "most", "least", "ids", "counts", "sizes", "papers", "allowed").repartition("shard").sortWithinPartitions("shard", "term", "gen", F.desc("sign"))
        return dealt.mapInArrow(search, "query_id long, chunk_id long, paper_id string, score_bm25 double")


class Postings:
    """Blocks of one term: ids in each block ascend, a block's bound is the weight its best chunk could have."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray]], bounds: np.ndarray) -> None:
        self.blocks, self.bounds = blocks, bounds
        self.low, self.high = np.array([i[0] for i, _ in blocks]), np.array([i[-1] for i, _ in blocks])
        self.bound = float(bounds.max())
        self.opened = 0

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        self.opened += len(self.blocks)
        return tuple(np.concatenate(x) for x in zip(*self.blocks, strict=True))

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """Weights of ascending ids, 0 for those without the term; only blocks that may hold one are opened."""
        out = np.zeros(len(wanted))
        first, end = np.searchsorted(wanted, self.low), np.searchsorted(wanted, self.high, "right")
        for k in np.flatnonzero(first < end).tolist():
            ids, weight = self.blocks[k]
            self.opened += 1
            part = wanted[first[k] : end[k]]
            at = np.minimum(np.searchsorted(ids, part), len(ids) - 1)
            out[first[k] : end[k]] += np.where(ids[at] == part, weight[at], 0.0)
        return out


class Shard:
    """The asked terms' postings of one shard, without chunks that a later generation took back."""

    def __init__(self, table: pa.Table, k1: float, b: float, mean: float) -> None:
        self.table, self.terms = table, {}
        names = table.column("term").to_pylist()
        sign, gen, most, least = (table.column(c).to_numpy() for c in ("sign", "gen", "most", "least"))
        lists = {c: table.column(c).combine_chunks() for c in ("ids", "counts", "sizes", "allowed")}
        at = lists["ids"].offsets.to_numpy()
        ids, counts, sizes = (lists[c].flatten().to_numpy() for c in ("ids", "counts", "sizes"))
        allowed = lists["allowed"].flatten().to_numpy(zero_copy_only=False) if lists["allowed"].null_count < len(table) else None
        at = at - at[0]
        norm = k1 * (1 - b + b * sizes / mean) if mean else np.zeros(len(sizes))
        weight = counts / (counts + norm)
        bound = most / (most + (k1 * (1 - b + b * least / mean) if mean else 0.0))
        edges = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
        for first, end in zip(edges[:-1], edges[1:], strict=True):
            live = range(first, end)
            blocks = [(ids[at[i] : at[i + 1]], weight[at[i] : at[i + 1]], None if allowed is None else allowed[at[i] : at[i + 1]].astype(bool)) for i in live]
            if (sign[first:end] < 0).any():
                # of a chunk's postings, as many as were taken back are gone, the oldest first
                gone = Counter(np.concatenate([i for i, s in zip(blocks, sign[first:end], strict=True) if s < 0 for i in [i[0]]]).tolist())
                left = []
                for k in np.argsort(gen[first:end], kind="stable").tolist():
                    if sign[first + k] > 0:
                        own, w, ok = blocks[k]
                        stay = np.ones(len(own), bool)
                        for j, chunk in enumerate(own.tolist()):
                            if gone.get(chunk, 0):
                                gone[chunk] -= 1
                                stay[j] = False
                        left.append((own[stay], w[stay], None if ok is None else ok[stay], bound[first + k]))
            else:
                left = [(*x, bound[first + k]) for k, x in enumerate(blocks)]
            kept = [(i if ok is None else i[ok], w if ok is None else w[ok], m) for i, w, ok, m in left]
            kept = [(i, w, m) for i, w, m in kept if len(i)]
            if kept:
                self.terms[names[first]] = Postings([(i, w) for i, w, _ in kept], np.array([m for *_, m in kept]))
        self.ids = np.unique(np.concatenate([i for p in self.terms.values() for i, _ in p.blocks])) if self.terms else np.zeros(0, np.int64)

    def scores(self, weights: list[tuple[str, float]], floor: float, top_k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores that may be among the best ``top_k``, all of those that are; ``floor`` is a score they must reach."""
        own = sorted(((w * self.terms[t].bound, w, t) for t, w in weights if t in self.terms and w > 0), key=lambda x: (-x[0], x[2]))
        under = [(w, t) for t, w in weights if t in self.terms and w < 0]
        if not own:
            return np.zeros(0, np.int64), np.zeros(0)
        rest = np.r_[np.cumsum([u for u, _, _ in own][::-1])[::-1], 0.0]
        sums, level, cand = np.zeros(len(self.ids)), floor, None
        for place, (_, w, t) in enumerate(own):
            if cand is None and not under and place and place & (place - 1) == 0 and rest[place] < sums.max(initial=0.0) and len(sums) > top_k:
                level = max(level, float(np.partition(sums, len(sums) - top_k)[len(sums) - top_k]))
            if cand is None and not under and level > rest[place] + SLACK:
                cand = np.flatnonzero(sums + rest[place] + SLACK >= level)
            if cand is None:
                ids, weight = self.terms[t].all()
                np.add.at(sums, np.searchsorted(self.ids, ids), w * weight)
            else:
                if not len(cand):
                    break
                sums[cand] += w * self.terms[t].of(self.ids[cand])
                cand = cand[sums[cand] + rest[place + 1] + SLACK >= level]
        for w, t in under:
            ids, weight = self.terms[t].all()
            np.add.at(sums, np.searchsorted(self.ids, ids), w * weight)
        at = np.flatnonzero(sums > 0) if cand is None else cand
        scores = np.round(sums[at], 9)
        return self.ids[at][scores > 0], scores[scores > 0]

    def papers(self, wanted: np.ndarray) -> dict[int, str]:
        """Papers of chunks that are in this shard, from their latest postings."""
        ids = self.table.column("ids").combine_chunks().flatten().to_numpy()
        at = np.flatnonzero(np.isin(ids, wanted) & np.repeat(self.table.column("sign").to_numpy() > 0, self.table.column("n").to_numpy()))
        gen = np.repeat(self.table.column("gen").to_numpy(), self.table.column("n").to_numpy())[at]
        at = at[np.argsort(gen, kind="stable")]
        names = self.table.column("papers").combine_chunks().flatten().take(pa.array(at)).to_pylist()
        return dict(zip(ids[at].tolist(), names, strict=True))
