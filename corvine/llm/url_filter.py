"""URL verdicts: host and path rules, and a character model ratio for URLs that no rule fits.

URLs that a rule decides train two smoothed variable-order Markov models over bytes, one for
accepted and one for rejected URLs.  Counts of contexts and of their continuations are exact by key (a
64-bit hash) and as many as there are keys; they are sorted by key, collected and sent to all tasks, 24
bytes a key; every URL counts, none is sampled.  The probability of a
byte backs off from order ``ORDER`` to 0 by ``(c(context, byte) + B * p_shorter) / (c(context) + B)``.
The score is the difference of log-likelihoods a byte.  A fifth of the ruled URLs (by hash) is kept
out of the counts; the threshold is the score that splits that fifth with the best balanced accuracy.

Defined results: a URL that is null or has no ``://`` has an empty host and path, no rule and score
0; without ruled URLs of both kinds the threshold is 0 (allow); repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import CASED, by_bytes, hash_words, text_arrays

ORDER, BACKOFF = 5, 2.0
#: Keys that a task holds before it sends their counts.
MOST_HELD = 2_000_000
#: Scores are counted in bins of this width up to this size, to find the threshold.
BIN, FAR = 0.005, 8.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """A-Z of the host are lower-cased; both are empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruling(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, what in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        where, slash, begins = what.partition("/")
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(slash + begins)
        rule, verdict = F.when(fits, what).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes that have ``order`` bytes before them in their URL; keys of context and of continuation."""
    place = np.arange(len(data))
    row = np.searchsorted(offsets, place, "right") - 1
    place = place[place - offsets[row] >= order]
    salt = np.uint64(order * 0x9E3779B97F4A7C15 & (2**64 - 1))
    context = hash_words(data, place - order, place, CASED) ^ salt
    longer = hash_words(data, place - order, place + 1, CASED) ^ salt ^ np.uint64(0xA5A5A5A5A5A5A5A5)
    return place, context, longer


def _counts(model: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Counts of keys in both classes, 0 of those that no URL has."""
    keys, counts = model
    if not len(keys):
        return np.zeros((2, len(wanted)))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return counts[:, at] * (keys[at] == wanted)


def _score(part: pa.RecordBatch, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    data, offsets = text_arrays(part.column(part.schema.get_field_index("address")))
    chance = np.full((2, len(data)), 1 / 256)
    for order in range(ORDER + 1):
        place, context, longer = _grams(data, offsets, order)
        chance[:, place] = (_counts(model, longer) + BACKOFF * chance[:, place]) / (_counts(model, context) + BACKOFF)
    gap = np.log(chance[1]) - np.log(chance[0])
    size = np.diff(offsets)
    return np.add.reduceat(np.r_[gap, 0], offsets[:-1]) * (size > 0) / np.maximum(size, 1)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row of ``pages``.

    Two passes count (models, threshold) and one scores; what is shuffled are the counts of keys.
    """
    host, path = host_and_path(pages[url].cast("string"))
    pages = pages.select(pages[page_id].alias("page_id"), host.alias("host"), path.alias("path"))
    rule, said = ruling(F.col("host"), F.col("path"), rules)
    pages = pages.select("*", rule.alias("rule"), said.alias("said"), F.concat("host", "path").alias("address"))
    ruled = pages.where("said is not null").select("address", (F.col("said") == "allow").cast("int").alias("good"))
    held = F.pmod(F.xxhash64("address"), F.lit(5)) == 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

        def flush() -> Iterator[pa.RecordBatch]:
            for k in (0, 1):
                if held[k]:
                    keys, back = np.unique(np.concatenate([h for h, _ in held[k]]), return_inverse=True)
                    n = np.bincount(back, np.concatenate([c for _, c in held[k]]), len(keys)).astype(np.int64)
                    held[k].clear()
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n * (1 - k)), pa.array(n * k)], ["key", "bad", "good"])

        for part in by_bytes(batches, "address"):
            good = part.column(1).to_numpy()
            data, offsets = text_arrays(part.column(0))
            for order in range(ORDER + 1):
                place, context, longer = _grams(data, offsets, order)
                kind = good[np.searchsorted(offsets, place, "right") - 1]
                for k in (0, 1):
                    held[k].append(np.unique(np.concatenate([context[kind == k], longer[kind == k]]), return_counts=True))
            if sum(len(h) for own in held for h, _ in own) > MOST_HELD:
                yield from flush()
        yield from flush()

    counted = ruled.where(~held).mapInArrow(count, "key long, bad long, good long").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    got = counted.toArrow()
    keys = got.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    counts = np.stack([got.column(c).to_numpy()[order] for c in ("bad", "good")]).astype(float)
    shared = pages.sparkSession.sparkContext.broadcast((keys[order], counts))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "address"):
            score = np.clip(_score(part, shared.value), -FAR, FAR)
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(score / BIN).astype(np.int64)), part.column(1)], ["bin", "good"])

    tally = ruled.where(held).mapInArrow(bins, "bin long, good int").groupBy("bin", "good").count().collect()
    threshold = best_threshold([(r["bin"], r["good"], r["count"]) for r in tally])

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "address"):
            score = _score(part, shared.value)
            said = np.where(score >= threshold, "allow", "block").tolist()
            said = [own or s for own, s in zip(part.column(4).to_pylist(), said, strict=True)]
            columns = [*part.columns[:4], pa.array(said, pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "host", "path", "rule", "verdict", "score"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInArrow(verdicts, f"page_id {kind}, host string, path string, rule string, verdict string, score double")


def best_threshold(tally: list[tuple[int, int, int]]) -> float:
    """The bin edge with the best balanced accuracy, the one nearest 0 of equals; 0 without both kinds."""
    n = [sum(c for _, g, c in tally if g == k) for k in (0, 1)]
    if not all(n):
        return 0.0
    edges = sorted({b for b, _, _ in tally} | {b + 1 for b, _, _ in tally} | {0})
    right = lambda e: sum(c for b, g, c in tally if g and b >= e) / n[1] + sum(c for b, g, c in tally if not g and b < e) / n[0]
    return max(edges, key=lambda e: (round(right(e), 12), -abs(e), e)) * BIN
