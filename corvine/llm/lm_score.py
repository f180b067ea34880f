"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

``P(w | h)`` is a product of class choices: the vocabulary is one class, cut into ``ARITY`` classes of about equal
mass along falling frequency, and each of them again until a class is one word.  So frequent words take one or two
choices and no word more than a few.  The words beyond the ``head`` fall into leaf classes by their hash, reached
through the same kind of choices.  Every choice is a softmax over sums of weights of hashed features of the
history: the last word, the last two, and the words two and three places back (skips), each hashed together with the
class that is left.  Inside a leaf a word has its share of the leaf's training tokens, and unseen words
share the mass of those seen once.  So the probabilities of all known words and of one unseen event a leaf sum to 1.

The model grows with the vocabulary ``V`` that is counted: ``head_size`` words, ``leaf_digits`` of leaf classes and
``row_bits`` of weight rows all follow the square root of ``V``, so what tasks hold stays far below the corpus.

Training goes in rounds over disjoint parts of all training documents: each task takes gradient steps
on its rows from the shared weights and sends the weights' change, half precision, in slices that
are averaged in two levels; a row's changes weigh by the gradient they have seen.  Scoring is batches of
sparse rows in numpy.

Word counts are exact over all training tokens and as many as there are words.  A histogram of the counts tells the count
from which on words are in the head; occurrences of other words meet their counts by a join on the
word, which no word is frequent enough to skew.

Defined results: a null or empty text has one token, its end; repeated rows each get a row; a row with a null id
is scored like any other; an empty table, or one without training documents, gives scores of 0 known words and
one unseen event a token; words of equal count are in the head together or not at all, ordered there by hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Slots, by_bytes, find_words, hash_words, kept, text_arrays

#: Classes a class is cut into; sizes at a vocabulary of one word, all growing with its square root.
ARITY = 8
HEAD, LEAVES, ROWS = 64, 16, 64
ROUNDS, FEATURES = 2, 4
BATCH, RATE, TREE = 32768, 0.25, 64
#: Words held by a task before it sends their counts.
MOST_HELD = 3_000_000
_U = np.uint64
END = np.uint64(0x1D8E4E27C47D124F)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def head_size(distinct: int) -> int:
    return max(1024, int(HEAD * math.sqrt(distinct)))


def leaf_digits(distinct: int) -> int:
    return max(1, math.ceil(math.log(max(LEAVES * math.sqrt(distinct), 1), ARITY) - 0.5))


def row_bits(distinct: int) -> int:
    return max(10, math.ceil(math.log2(ROWS * math.sqrt(max(distinct, 1)))))


def token_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each followed by its end; ``len + 1`` edges."""
    starts, ends, rows = find_words(data, offsets)
    n = len(offsets) - 1
    edges = np.searchsorted(rows, np.arange(n + 1)) + np.arange(n + 1)
    out = np.full(len(rows) + n, END)
    out[np.arange(len(rows)) + rows] = np.maximum(hash_words(data, starts, ends), _U(1))
    return out, edges


def cut_classes(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Paths from the root to items of falling ``mass``: edges, and class and choice of each step; masses by class.

    A class's items are cut where their running mass passes the next share of the class's.
    """
    item, of = np.arange(len(mass)), np.zeros(len(mass), np.int64)
    steps, sums, classes = [], [], 1
    while len(item):
        fresh = np.r_[True, of[1:] != of[:-1]]
        begin = np.flatnonzero(fresh)
        size = np.diff(np.r_[begin, len(item)])
        own = mass[item]
        before = np.cumsum(own) - own
        before = before - np.repeat(before[begin], size)
        slot = np.minimum(before * (ARITY / np.repeat(np.add.reduceat(own, begin), size)), ARITY - 1).astype(np.int64)
        change = np.r_[True, slot[1:] != slot[:-1]] | fresh
        nth = np.cumsum(change) - 1
        digit = nth - np.repeat(nth[begin], size)
        steps.append((item, of, digit))
        sums.append(np.bincount((of - of[0]) * ARITY + digit, own, (of[-1] - of[0] + 1) * ARITY).reshape(-1, ARITY))
        group = np.flatnonzero(change)
        members = np.diff(np.r_[group, len(item)])
        more = np.repeat(members > 1, members)
        name = classes + np.cumsum(members > 1) - 1
        item, of = item[more], np.repeat(name, members)[more]
        classes += int((members > 1).sum())
    item, of, digit = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.argsort(item, kind="stable")
    return np.searchsorted(item[order], np.arange(len(mass) + 1)), of[order], digit[order], np.concatenate(sums)


class Model:
    """Vocabulary and weights.

    ``head`` are the hashes of the head's words in falling order of ``counts``; ``leaf_tokens`` and ``leaf_once`` tell of each
    leaf class the training tokens of words beyond the head, and the words seen once.
    """

    def __init__(self, head: np.ndarray, counts: np.ndarray, leaf_tokens: np.ndarray, leaf_once: np.ndarray, total: int, distinct: int, bits: int | None = None) -> None:
        self.head, self.counts, self.total, self.distinct = head, counts, total, distinct
        self.leaf_tokens, self.leaf_once = leaf_tokens.astype(float), np.maximum(leaf_once, 1).astype(float)
        self.bits = bits or row_bits(distinct)
        self.table = np.zeros((1 << self.bits, ARITY), np.float32)
        self._paths()
        self.slots = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"slots": None}

    def _paths(self) -> None:
        """Steps of the head's words, then of the leaves, one after the other; biases that make it the unigram model."""
        leaf = self.leaf_tokens + self.leaf_once
        mass = np.r_[self.counts.astype(float), leaf.sum()]
        order = np.argsort(-mass, kind="stable")
        edges, of, digit, sums = cut_classes(mass[order])
        place = np.argsort(order)
        length = np.diff(edges)[place]
        pick = np.repeat(edges[:-1][place] - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
        cut = length[:-1].sum()
        head_of, head_digit, trunk_of, trunk_digit = of[pick[:cut]], digit[pick[:cut]], of[pick[cut:]], digit[pick[cut:]]
        n, digits, base, below = len(leaf), round(math.log(len(leaf), ARITY)), len(sums), []
        number = np.arange(n)
        for k in range(digits):
            below.append((base + number // ARITY ** (digits - k), number // ARITY ** (digits - k - 1) % ARITY))
            sums = np.concatenate([sums, leaf.reshape(ARITY ** (k + 1), -1).sum(1).reshape(-1, ARITY)])
            base += ARITY**k
        leaf_of = np.column_stack([np.tile(trunk_of, (n, 1)), *[b[0] for b in below]])
        leaf_digit = np.column_stack([np.tile(trunk_digit, (n, 1)), *[b[1] for b in below]])
        self.of = np.concatenate([head_of, leaf_of.ravel()]).astype(np.int32)
        self.digit = np.concatenate([head_digit, leaf_digit.ravel()]).astype(np.uint8)
        self.edges = np.r_[0, np.cumsum(np.r_[length[:-1], np.full(n, leaf_of.shape[1])])]
        self.bias = np.log(np.maximum(sums, 1e-9)).astype(np.float32)
        self.bias -= self.bias.max(1, keepdims=True)

    def targets(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each token's path: its rank in the head, or the head's size and its leaf."""
        if self.slots is None:
            self.slots = Slots(max(10, math.ceil(math.log2(len(self.head) + 1)) + 1))
            self.slots.add(self.head, np.arange(len(self.head)))
        rank = self.slots.find(hashes)
        return np.where(rank < 0, len(self.head) + leaf_of(hashes, len(self.leaf_once)), rank)

    @staticmethod
    def history(hashes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
        """64-bit keys of the features of each token's history."""
        n = len(hashes)
        back = [np.concatenate([np.full(min(k, n), END), hashes[: max(n - k, 0)]]) for k in (1, 2, 3)]
        for k in (1, 2, 3):
            for j in range(k):
                at = edges[:-1] + j
                back[k - 1][at[at < edges[1:]]] = END
        return back[0] * _ODD[0], (back[0] ^ (back[1] << _U(1))) * _ODD[1], back[1] * _ODD[2], back[2] * _ODD[3]

    def steps(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token, class and choice of every step of the tokens' paths."""
        begin = self.edges[target]
        length = self.edges[target + 1] - begin
        token = np.repeat(np.arange(len(target)), length)
        pick = np.repeat(begin - np.cumsum(length) + length, length) + np.arange(len(token))
        return token, self.of[pick], self.digit[pick]

    def rows(self, keys: tuple[np.ndarray, ...], token: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
        """The weight row of each feature at each step."""
        salt, shift = of.astype(np.uint64) * _ODD[2] + _ODD[1], _U(64 - self.bits)
        return [(((k[token] ^ salt) * _ODD[0]) >> shift).astype(np.int64) for k in keys]

    def chances(self, rows: list[np.ndarray], of: np.ndarray) -> np.ndarray:
        """Softmax over the choices (first axis) of each step."""
        total, part = self.bias.take(of, 0), np.empty((len(of), ARITY), np.float32)
        for r in rows:
            total += self.table.take(r, 0, part, "clip")
        out = np.ascontiguousarray(total.T)
        out -= out.max(0)
        np.exp(out, out)
        out /= out.sum(0)
        return out

    def score(self, hashes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the probability of each token's path; the number of the path."""
        target, keys, out = self.targets(hashes), self.history(hashes, edges), np.zeros(len(hashes))
        for a in range(0, len(hashes), BATCH):
            token, of, digit = self.steps(target[a : a + BATCH])
            chance = self.chances(self.rows([k[a : a + BATCH] for k in keys], token, of), of)
            n = len(target[a : a + BATCH])
            out[a : a + n] = np.bincount(token, np.log10(chance[digit, np.arange(len(of))]), n)
        return out, target

    def learn(self, hashes: np.ndarray, edges: np.ndarray, speed: np.ndarray) -> None:
        """One pass of gradient steps (Adagrad by row) over the tokens; a weight moves by ``RATE`` at most in a step."""
        target, keys = self.targets(hashes), self.history(hashes, edges)
        number = np.empty(len(self.table), np.int32)
        for a in range(0, len(hashes), BATCH):
            token, of, digit = self.steps(target[a : a + BATCH])
            rows = self.rows([k[a : a + BATCH] for k in keys], token, of)
            error = self.chances(rows, of)
            error[digit, np.arange(len(of))] -= 1
            met = np.zeros(len(self.table), bool)
            for r in rows:
                met[r] = True
            own = np.flatnonzero(met)
            number[own] = np.arange(len(own), dtype=np.int32)
            flat = np.concatenate([number[r] for r in rows])
            slope = np.stack([np.bincount(flat, np.tile(e.astype(float), FEATURES), len(own)) for e in error])
            speed[own] += np.square(slope).max(0)
            slope *= RATE / np.sqrt(speed[own])
            self.table[own] -= slope.T.astype(np.float32)


def leaf_of(hashes: np.ndarray, leaves: int) -> np.ndarray:
    return ((hashes >> _U(20)) % _U(leaves)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over rows with ``text``: exact counts of all tokens by word hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, back = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            n = np.bincount(back, np.concatenate([c for _, c in held]), len(keys)).astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["word", "n"])

        for part in by_bytes(batches, "text"):
            hashes, _ = token_stream(*text_arrays(part.column(part.schema.get_field_index("text"))))
            held.append(np.unique(hashes, return_counts=True))
            size += len(held[-1][0])
            if size > MOST_HELD:
                yield flush()
                size = 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_count(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` words reach, from a histogram of the counts (bins a 64th of a power of two wide)."""
    bins = counts.groupBy(F.floor(F.log2("n") * 64).alias("bin")).agg(F.count("*").alias("words"), F.min("n").alias("least"), F.max("n").alias("largest"))
    bins = sorted(bins.collect(), key=lambda r: -r["bin"])
    cut, words = bins[0]["largest"] + 1 if bins else 1, 0
    for r in bins:
        words += r["words"]
        if words > most:
            break
        cut = r["least"]
    return cut


def vocabulary(learning: DataFrame) -> tuple[Model, DataFrame]:
    """The untrained model, and ``word, n`` of the words beyond its head."""
    counts = kept(word_counts(learning))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    cut = head_count(counts, head_size(sums["v"]))
    head = counts.where(F.col("n") >= cut).toArrow()
    names, size = head.column("word").to_numpy().view(np.uint64), head.column("n").to_numpy()
    order = np.lexsort((names, -size))
    leaves = ARITY ** leaf_digits(sums["v"])
    leaf = F.pmod(F.shiftrightunsigned("word", 20), F.lit(leaves)).alias("leaf")
    outside = F.sum(F.when(F.col("n") < cut, F.col("n")).otherwise(0)).alias("n")
    tails = counts.where((F.col("n") < cut) | (F.col("n") == 1)).groupBy(leaf).agg(outside, F.sum((F.col("n") == 1).cast("long")).alias("once")).toArrow()
    tokens, once = np.zeros(leaves), np.zeros(leaves)
    at = tails.column("leaf").to_numpy()
    tokens[at], once[at] = tails.column("n").to_numpy(), tails.column("once").to_numpy()
    return Model(names[order], size[order], tokens, once, sums["n"], sums["v"]), counts.where(F.col("n") < cut)


def train(docs: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """Rounds of distributed gradient steps over rows with ``doc_id, text``."""
    spark = docs.sparkSession
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def steps(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own: Model = shared.value
            start, own.table = own.table, own.table.copy()
            speed, pending, size = np.ones(len(start), np.float32), [], 0

            def step() -> None:
                edges = np.cumsum(np.concatenate([[0], *[np.diff(e) for _, e in pending]]))
                own.learn(np.concatenate([h for h, _ in pending]), edges, speed)
                pending.clear()

            for part in by_bytes(batches, "text"):
                pending.append(token_stream(*text_arrays(part.column(1))))
                size += len(pending[-1][0])
                if size >= BATCH:
                    step()
                    size = 0
            if pending:
                step()
            change, own.table = own.table - start, start
            weight = np.sqrt(speed - 1)
            if not weight.any():
                return
            parts = [[x.astype(np.float16).tobytes() for x in np.array_split(y, TREE)] for y in (change, weight)]
            branch = (TaskContext.get().partitionId() if TaskContext.get() else 0) // TREE
            columns = [pa.array(range(TREE), pa.int64()), pa.array([branch] * TREE, pa.int64()), *(pa.array(p, pa.binary()) for p in parts)]
            yield pa.RecordBatch.from_arrays(columns, ["piece", "branch", "change", "weight"])

        part = docs.where(F.pmod(F.xxhash64(F.lit("round"), "doc_id"), F.lit(rounds)) == turn).select("doc_id", "text")
        sent = part.mapInArrow(steps, "piece long, branch long, change binary, weight binary")
        first = sent.groupBy("piece", "branch").applyInArrow(_averaged(np.float16), _PIECE)
        got = first.groupBy("piece").applyInArrow(_averaged(np.float32), _PIECE).toArrow()
        if got.num_rows:
            pieces = dict(zip(got.column("piece").to_pylist(), got.column("change").to_pylist(), strict=True))
            model.table = model.table + np.frombuffer(b"".join(pieces[k] for k in range(TREE)), np.float32).reshape(model.table.shape)
        shared.unpersist()
    return model


_PIECE = "piece long, change binary, weight binary"


def _averaged(kind: type):
    """Means of rows' changes, each weighted by the gradient behind it."""

    def average(table: pa.Table) -> pa.Table:
        total = weight = 0.0
        for change, w in zip(table.column("change"), table.column("weight"), strict=True):
            w = np.frombuffer(w.as_py(), kind).astype(float)
            total, weight = total + np.frombuffer(change.as_py(), kind).reshape(len(w), ARITY) * w[:, None], weight + w
        mean = total / np.where(weight > 0, weight, 1)[:, None]
        values = [pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in (mean, weight)]
        return pa.table([pa.array([table.column("piece")[0].as_py()], pa.int64()), *values], names=["piece", "change", "weight"])

    return average


def score_documents(docs: DataFrame, learn_from, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    learning = docs.where(learn_from(F.col("doc_id")))
    model, rare = vocabulary(learning)
    shared = spark.sparkContext.broadcast(train(learning, model))
    floor = math.log10(model.total + model.distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        plus, once = np.log10(own.counts + 1.0), np.log10(own.leaf_once)
        unseen = once - np.log10(own.leaf_tokens + own.leaf_once)
        for part in by_bytes(batches, "text"):
            hashes, edges = token_stream(*text_arrays(part.column(1)))
            logs, target = own.score(hashes, edges)
            n = np.diff(edges)
            row, base = np.repeat(np.arange(len(n)), n), np.full(len(hashes), -floor)
            known = target < len(own.head)
            base[known] += plus[target[known]]
            # words beyond the head: counted as unseen here, corrected by the join
            far = np.flatnonzero(~known)
            leaf = target[far] - len(own.head)
            logs[far] += unseen[leaf]
            stats = [part.column(0), pa.array(n), pa.array(np.bincount(row[known], minlength=len(n))), pa.array(np.bincount(row, base, len(n))), pa.array(np.bincount(row, logs, len(n)))]
            keys, none = part.column(2), pa.array(np.zeros(len(n)))
            yield pa.RecordBatch.from_arrays([keys, keys, pa.array(np.zeros(len(n), np.int32)), none, pa.StructArray.from_arrays(stats, fields=list(_STATS))], _PART)
            if far.size:
                order = np.lexsort((hashes[far], row[far]))
                far, leaf = far[order], leaf[order]
                first = np.flatnonzero(np.r_[True, (row[far[1:]] != row[far[:-1]]) | (hashes[far[1:]] != hashes[far[:-1]])])
                times = np.diff(np.r_[first, len(far)]).astype(np.int32)
                keys = keys.take(pa.array(row[far[first]]))
                yield pa.RecordBatch.from_arrays([keys, pa.array(hashes[far[first]].view(np.int64)), pa.array(times), pa.array(once[leaf[first]]), pa.nulls(len(first), _STATS)], _PART)

    # the key is the row's place in its partition: all rows of a document come from one task
    keyed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("key"))
    parts = keyed.mapInArrow(run, "key long, word long, times int, once double, stats struct<doc_id:long,n_tokens:long,n_known:long,base:double,score:double>")
    # rows of a document itself have times 0, so whatever they meet adds nothing
    met = parts.join(rare, "word", "left").groupBy("key").agg(
        F.max("stats").alias("stats"),
        F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("times"))), F.lit(0)).alias("more"),
        F.coalesce(F.sum(F.col("times") * F.log10(F.col("n") + 1)), F.lit(0.0)).alias("base_more"),
        F.coalesce(F.sum(F.col("times") * (F.log10("n") - F.col("once"))), F.lit(0.0)).alias("score_more"),
    )
    return met.select(
        "stats.doc_id", "stats.n_tokens", (F.col("stats.n_known") + F.col("more")).alias("n_known"), F.lit(int(model.total)).cast("long").alias("train_tokens"),
        (F.col("stats.base") + F.col("base_more")).alias("base_score"), (F.col("stats.score") + F.col("score_more")).alias("score"),
    )


_STATS = pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
_PART = ["key", "word", "times", "once", "stats"]
