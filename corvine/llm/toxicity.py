"""Toxicity by bags of subword embeddings: the mean embedding of a text under a linear softmax.

A word's vector is the mean of the embeddings of its character n-grams (``GRAMS`` bytes long, with
word edges marked), a text's vector is the mean over its words, and a two-class softmax reads it.
Embeddings and softmax are trained jointly (full-batch Adam with weight decay, numpy).  As the
n-grams are hashed into ``2 ** BUCKET_BITS`` rows, a misspelt or unseen word shares the vectors of
its parts with words of the training texts.

Training reads a sample of labelled rows of documented size: at most ``rows_a_label`` texts of each
label, those with the smallest hashes of their ids, until they have ``train_bytes`` bytes; the sample takes
texts whole, but for a single one longer than all of ``train_bytes``.  Scoring
reads every text whole and needs no shuffle: a trained model is one number a bucket.

Defined results: a null or empty text has no words and gets the score of an empty bag (below the
training base rate, so it is clean); several labels of one id count as toxic if one is; without
training rows of both labels every score is 0; rows may repeat (of one id's texts the first by code point
trains); columns not carried are ignored, and a carried one must not be named ``doc_id`` or ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import FOLDED, Slots, by_bytes, find_words, hash_words, text_arrays

BUCKET_BITS, WIDTH, GRAMS = 16, 8, (3, 4, 5)
STEPS, RATE, DECAY, BOOST = 80, 0.1, 2e-6, 60.0
#: The share of toxic texts that the training weights stand for.
PRIOR = 0.25
#: Blank words (zero vectors) averaged with each text, so that one word of a short text decides nothing.
BLANKS = 20.0


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of ``<word>``, and the word of each."""
    data = np.frombuffer(b"".join(b"<" + w.lower() + b">" for w in words), np.uint8)
    edges = np.r_[0, np.cumsum([len(w) + 2 for w in words])]
    place = np.arange(len(data))
    word = np.searchsorted(edges, place, "right") - 1
    buckets, owners = [], []
    for n in GRAMS:
        at = place[place + n <= edges[word + 1]]
        buckets.append((hash_words(data, at, at + n) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
        owners.append(word[at].astype(np.int32))
    return np.concatenate(buckets), np.concatenate(owners)


class Toxicity:
    """``weights``: for each bucket the embedding times the difference of the softmax rows."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        buckets, owners = subwords(words)
        n = np.maximum(np.bincount(owners, minlength=len(words)), 1)
        return np.bincount(owners, self.weights[buckets], len(words)) / n


def fit(texts: list[str], labels: np.ndarray, seed: int = 7) -> Toxicity | None:
    """Joint training of embeddings and softmax; ``None`` without both labels."""
    if len(set(labels.tolist())) < 2:
        return None
    data, offsets = text_arrays(pa.array(texts, pa.string()))
    starts, ends, rows = find_words(data, offsets)
    _, at, word = np.unique(hash_words(data, starts, ends), return_index=True, return_inverse=True)
    raw = data.tobytes()
    buckets, owners = subwords([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
    words, docs, size = len(at), len(texts), 1 << BUCKET_BITS
    share = (1 / np.maximum(np.bincount(owners, minlength=words), 1)).astype(np.float32)[owners]
    length = np.bincount(rows, minlength=docs) + BLANKS
    weight = np.where(labels == 1, PRIOR / labels.mean(), (1 - PRIOR) / (1 - labels.mean())) / docs
    rng = np.random.default_rng(seed)
    table, softmax, bias = rng.normal(0, 0.1, (size, WIDTH)), rng.normal(0, 1, (WIDTH, 2)), np.zeros(2)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, softmax, bias)]
    for step in range(1, STEPS + 1):
        lean = softmax[:, 1] - softmax[:, 0]
        each = (table @ lean).astype(np.float32)
        of_word = np.bincount(owners, each[buckets] * share, words)
        logit = BOOST * np.bincount(rows, of_word[word], docs) / length + bias[1] - bias[0]
        error = (1 / (1 + np.exp(-logit)) - labels) * weight
        back = np.bincount(word, (BOOST * error / length)[rows], words).astype(np.float32)
        slope = np.bincount(buckets, back[owners] * share, size)
        turn = slope @ table
        grads = (np.outer(slope, lean), np.stack([-turn, turn], 1), np.array([-error.sum(), error.sum()]))
        for p, g, (m, v) in zip((table, softmax, bias), grads, state, strict=True):
            g = g + DECAY * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Toxicity((table @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def sample(docs: DataFrame, marks: DataFrame, rows_a_label: int, train_bytes: int) -> DataFrame:
    """``doc_id, text, label``: of each label the ``rows_a_label`` ids in ``docs`` with the smallest hashes, to ``train_bytes`` of text.

    Labels are counted first, so that only a few times as many rows as are wanted go to the task that sorts them.
    """
    marks = marks.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("rank", F.xxhash64("doc_id"))
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}

    def few(label: int) -> DataFrame:
        own, share = marks.where(F.col("label") == label), 4 * rows_a_label / max(counts.get(label, 0), 1)
        if share < 1:
            own = own.where(F.col("rank") < int(share * 2**64) - 2**63)
        return own.orderBy("rank", "doc_id").limit(rows_a_label)

    chosen = docs.join(F.broadcast(few(0).unionByName(few(1))), "doc_id")
    chosen = chosen.groupBy("doc_id", "rank").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").alias("label"))
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy("rank", "doc_id")) - F.octet_length("text")
    cut = F.when(F.octet_length("text") > train_bytes, F.left("text", F.lit(train_bytes))).otherwise(F.col("text"))
    return chosen.withColumn("before", before).where(F.col("before") < train_bytes).select("doc_id", cut.alias("text"), "label")


def score_texts(
    docs: DataFrame, labels: DataFrame, learn_from, rows_a_label: int = 2500, train_bytes: int = 1 << 23, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", carry: Sequence[str] = ()
) -> DataFrame:
    """``doc_id, score`` and the columns ``carry`` for every row of ``docs``; ``learn_from`` is a condition on the id column."""
    spark = docs.sparkSession
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"), *[docs[c].alias(f"carried{i}") for i, c in enumerate(carry)])
    marks = labels.select(labels[doc_id].cast("long").alias("doc_id"), labels[label].cast("int").alias("label"))
    marks = marks.where(learn_from(F.col("doc_id")) & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    fitting = sample(docs.select("doc_id", "text"), marks, rows_a_label, train_bytes)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(zip(*(sum((b.column(k).to_pylist() for b in held), []) for k in range(3)), strict=True)) if (held := list(batches)) else []
        model = fit([r[1] for r in rows], np.array([r[2] for r in rows])) if rows else None
        if model is not None:
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], ["weights", "bias"])

    # the sample is bounded, so one task can train; a lost executor trains again
    got = fitting.select("doc_id", "text", "label").repartition(1).mapInArrow(learn, "weights binary, bias double").collect()
    model = Toxicity(np.frombuffer(got[0]["weights"], np.float32), got[0]["bias"]) if got else None
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), *[F.col(f"carried{i}").alias(c) for i, c in enumerate(carry)])
    shared = spark.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Toxicity(*shared.value)
        known, scores = Slots(21), np.zeros(1 << 21, np.float32)
        for part in by_bytes(batches, "text"):
            data, offsets = text_arrays(part.column(1))
            starts, ends, rows = find_words(data, offsets)
            hashes = hash_words(data, starts, ends)
            found = known.find(hashes)
            value = scores[found]
            if (miss := np.flatnonzero(found < 0)).size:
                keys, at, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
                raw, at = data.tobytes(), miss[at]
                new = model.word_scores([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
                value[miss] = new[back]
                if not known.room(len(keys)):
                    known = Slots(21)
                if known.room(len(keys)):
                    scores[known.used : known.used + len(keys)] = new
                    known.add(keys, np.arange(known.used, known.used + len(keys)))
            n = len(offsets) - 1
            mean = np.bincount(rows, value, n) / (np.bincount(rows, minlength=n) + BLANKS)
            score = 1 / (1 + np.exp(-np.clip(BOOST * mean + model.bias, -500, 500)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), *part.columns[2:]], ["doc_id", "score", *carry])

    return docs.mapInArrow(run, f"doc_id long, score double{kinds}")
