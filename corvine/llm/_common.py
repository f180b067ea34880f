"""Helpers shared by the training-data operators: session folders, Arrow slices, word hashing.

A *word* is a maximal run of bytes outside ``0x20`` and ``0x09``-``0x0D``; A-Z are folded to a-z
and nothing else is.  Words are identified by a 64-bit hash: the sum of splitmix finalisers of
the word's 8-byte blocks, each keyed by its place, finalised again with the word's length.  Two different
words of the same text collection collide with a probability near 2**-64; nobody is kept from making
collisions on purpose, so whoever must not confuse words compares their bytes (``SpanTable``).
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES, SLICE_ROWS = 1 << 18, 16384

_U = np.uint64
CASED = np.arange(256, dtype=np.uint8)
FOLDED = CASED.copy()
FOLDED[65:91] = CASED[97:123]
WHITE, BLANK = np.zeros(256, bool), np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
BLANK[32] = True
_PLACE, _SIZE = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column as one array, with ``len + 1`` offsets; null is empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each slice has at most ``most`` bytes of text and ``SLICE_ROWS`` rows, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_arrays(batch.column(batch.schema.get_field_index(column)))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1
            end = min(max(end, begin + 1), begin + SLICE_ROWS, batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def find_words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the row of each."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~space[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))


def blocks_of(data: np.ndarray, fold: np.ndarray = CASED) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    np.take(fold, data, out=padded[: len(data)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = FOLDED) -> np.ndarray:
    """A 64-bit hash of each span; A-Z are folded unless ``fold`` is ``CASED``."""
    blocks, size = blocks_of(data, fold), ends - starts
    total = mix((blocks[starts] & _FIRST[np.minimum(size, 8)]) ^ _PLACE)
    if (long_ := np.flatnonzero(size > 8)).size:
        more = (size[long_] - 1) // 8
        edge = np.r_[0, np.cumsum(more)]
        nth = np.arange(edge[-1]) - np.repeat(edge[:-1], more) + 1
        at = np.repeat(starts[long_], more) + 8 * nth
        part = blocks[at] & _FIRST[np.minimum(np.repeat(ends[long_], more) - at, 8)]
        total[long_] += np.add.reduceat(mix(part ^ mix((nth + 1).astype(np.uint64) * _PLACE)), edge[:-1])
    return mix(total + size.astype(np.uint64) * _SIZE)


def scratch_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where that is unset, a temporary folder of this machine serves local sessions only; on a cluster it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="corvine-"))
    return named or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def kept(frame: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, which outlives any executor."""
    scratch_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


#: Rows that may be broadcast after they have been counted, and the share of a frame's rows beyond which a key is hot.
BROADCAST_ROWS, HOT = 500_000, 1 / 4096


def spread_join(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner", most: int | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and in ``weight`` the number of left rows with it.

    Up to ``most`` rows (counted) are broadcast.  Beyond, hot keys are: there are at most ``1 / HOT`` of them;
    the others meet in a shuffle that no key can skew.
    """
    total = right.agg(F.count("*").alias("rows"), F.coalesce(F.sum(weight), F.lit(0)).alias("weight")).first()
    right_ = right.drop(weight)
    if total["rows"] <= (BROADCAST_ROWS if most is None else most):
        return left.join(F.broadcast(right_), key, how)
    hot = F.col(weight) > total["weight"] * HOT
    often, seldom = right.where(hot).drop(weight), right.where(~hot).drop(weight)
    rest = left.join(F.broadcast(often.select(key)), key, "left_anti").join(seldom, key, how)
    return left.join(F.broadcast(often), key).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Slots:
    """An open-addressing table from 64-bit hashes to small integers, searched a whole array at a time."""

    def __init__(self, bits: int) -> None:
        self.mask = _U((1 << bits) - 1)
        self.keys, self.values, self.used = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), 0

    def room(self, more: int) -> bool:
        return (self.used + more) * 10 <= len(self.keys) * 7

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The value of each hash; -1 where there is none."""
        hashes = np.maximum(hashes, _U(1))
        at = (hashes & self.mask).astype(np.int64)
        held = self.keys[at]
        out = np.where(held == hashes, self.values[at], -1)
        open_ = np.flatnonzero((held != hashes) & (held != 0))
        while open_.size:
            at[open_] = (at[open_] + 1) & int(self.mask)
            held = self.keys[at[open_]]
            own = held == hashes[open_]
            out[open_[own]] = self.values[at[open_[own]]]
            open_ = open_[~own & (held != 0)]
        return out

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Adds hashes that are distinct and not there yet; ``room`` has been asked."""
        hashes = np.maximum(hashes, _U(1))
        at, open_ = (hashes & self.mask).astype(np.int64), np.arange(len(hashes))
        self.used += len(hashes)
        while open_.size:
            free = open_[self.keys[at[open_]] == 0]
            self.keys[at[free]] = hashes[free]  # the last of those that meet in a slot stays
            own = self.keys[at[open_]] == hashes[open_]
            self.values[at[open_[own]]] = values[open_[own]]
            open_ = open_[~own]
            at[open_] = (at[open_] + 1) & int(self.mask)


class SpanTable:
    """Numbers of byte spans, found by hash and confirmed by their bytes, so that colliding hashes confuse nothing."""

    def __init__(self, bits: int) -> None:
        self.slots = Slots(bits)
        self.exact, self.size = np.zeros((2, 1 << bits), np.uint64), np.zeros(1 << bits, np.int64)
        self.longer: dict[int, bytes] = {}

    def find(self, spans: Spans) -> np.ndarray:
        """The number of each span, -1 where it is unknown."""
        out = self.slots.find(spans.hashes)
        at = np.maximum(out, 0)
        out[(self.size[at] != spans.size) | (self.exact[0, at] != spans.exact[0]) | (self.exact[1, at] != spans.exact[1])] = -1
        for i in np.flatnonzero((out >= 0) & (spans.size > 16)).tolist():
            if self.longer[int(out[i])] != spans.bytes(i):
                out[i] = -1
        return out

    def add(self, spans: Spans, which: np.ndarray, numbers: np.ndarray) -> None:
        """Remembers spans of distinct hashes if there is room; one whose hash is taken by another is left out."""
        free = self.slots.find(spans.hashes[which]) < 0
        which, numbers = which[free], numbers[free]
        if not self.slots.room(len(which)):
            return
        self.slots.add(spans.hashes[which], numbers)
        self.exact[:, numbers], self.size[numbers] = spans.exact[:, which], spans.size[which]
        for i, n in zip(which.tolist(), numbers.tolist(), strict=True):
            if spans.size[i] > 16:
                self.longer[n] = spans.bytes(i)


class Spans:
    """Spans of a byte array: hashes, sizes, the first 16 bytes as two numbers."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        self.raw, self.starts, self.ends, self.hashes, self.size = data.tobytes(), starts, ends, hashes, ends - starts
        blocks = blocks_of(data)
        second = blocks[np.minimum(starts + 8, len(data))] & _FIRST[np.clip(self.size - 8, 0, 8)]
        self.exact = np.stack([blocks[starts] & _FIRST[np.minimum(self.size, 8)], second])

    def bytes(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i]]

    def distinct(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the spans ``which``: one of each kind, and the kind of each; spans of a kind have equal bytes."""
        _, at, back = np.unique(self.hashes[which], return_index=True, return_inverse=True)
        first = which[at][back]
        differs = (self.size[which] != self.size[first]) | (self.exact[:, which] != self.exact[:, first]).any(0)
        for k in np.flatnonzero(~differs & (self.size[which] > 16) & (which != first)).tolist():
            differs[k] = self.bytes(which[k]) != self.bytes(first[k])
        if (odd := np.flatnonzero(differs)).size:  # spans that collide are kinds of their own
            back[odd] = len(at) + np.arange(len(odd))
            at = np.concatenate([at, odd])
        return which[at], back
