"""Packing token ids of documents into training sequences by the sum-of-squares rule.

A document is its token ids followed by one end id.  It is cut into full windows of ``WINDOW`` ids
and one remainder; a full window is a sequence of its own.  Remainders are packed online: with
``open[h]`` the number of unfinished sequences at fill level ``h``, a remainder of ``r`` ids goes to
the level (or to a new sequence) that minimises the sum over ``h`` of ``open[h] ** 2`` afterwards.
The level array has ``WINDOW`` entries whatever the number of documents; of equal levels the lowest wins.
When a task has seen all its documents, the fullest sequences still open are filled from the emptiest, and
the last one is cut into powers of two, so that no padding remains (``settle``).

Every input partition is packed by itself (no shuffle); the partition number makes sequence ids
unique and a task that runs again gives the same result.  The open sequences are few hundred whatever the
partition's size, so the share of remainders that ``settle`` moves falls with it; README has it measured.

Defined results: a null text is an empty document, which is the end id alone; repeated rows are
separate documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._common import CASED, WHITE, Spans, SpanTable, by_bytes, hash_words, text_arrays

#: Size of the table of parts whose ids a Python worker remembers; when full it starts anew.
MEMORY_BITS = 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ready: dict[str, WordIds] = {}

_LETTER, _MARK, _DIGIT, _ODD = 1, 2, 3, 4
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _MARK
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[39] = _ODD
_KIND[WHITE] = 0


#: Pieces of the probes that tell whether a tokenizer cuts as ``parts_of`` does.
_PROBES = ("", " ", "  ", "The", "theory", "ABC", "é", "Ä", "1", "23", "-", "!?", "...", "\n", "\t", "'s", "|", "<", "unbelievably", "x")


def parts_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the parts of all texts, the row of each, and whether it is an odd word.

    A word of letters (a-z and the Latin-1 ones), digits and ASCII marks is cut where its kind of
    character changes and around each digit, as the tokenizer's pattern does.  A word with any other
    character, an apostrophe or the opening of a special token is odd and stays whole.
    """
    n = len(data)
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    bar = np.flatnonzero(data == 124)
    kind[bar[(bar > 0) & (data[bar - 1] == 60)]] = _ODD
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    inside = kind != 0
    begin = np.empty(n, bool)
    begin[0] = True
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT) | fresh[1:-1]
    begin &= inside
    if (kind == _ODD).any():
        first = inside.copy()
        first[1:] &= ~inside[:-1] | fresh[1:-1]
        word = np.cumsum(first) - 1
        odd_word = np.zeros(word[-1] + 2, bool)
        odd_word[word[kind == _ODD]] = True
        begin &= first | ~odd_word[word]
    starts = np.flatnonzero(begin)
    end = inside
    end[:-1] &= (kind[1:] == 0) | begin[1:] | fresh[1:-1]
    odd = np.zeros(len(starts), bool) if not (kind == _ODD).any() else odd_word[word[starts]]
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1, odd


class WordIds:
    """Token ids of texts under a tokenizer that drops white space and never joins across it.

    Texts are cut into parts by array operations; each distinct part is encoded once by the
    library's model and remembered.  Odd words go through the library whole.  A tokenizer whose ids of the
    probes differ from the library's does not split so, and whole texts go through the library.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        shown = ((c, level.pre_tokenize_str(c)[0][0]) for c in map(chr, range(33, 256)) if c.isprintable())
        self.letters = str.maketrans(dict(shown))
        self.splits = True
        self.forget()
        probe = [p + q for p in _PROBES for q in _PROBES]
        ids, edges = self.encode(*text_arrays(pa.array(probe)))
        whole = [e.ids for e in self.tokenizer.encode_batch(probe, add_special_tokens=False)]
        self.splits = whole == [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def forget(self) -> None:
        self.known, self.count = SpanTable(MEMORY_BITS), 0
        self.ids, self.edges = np.zeros(1 << 16, np.uint32), np.zeros((1 << MEMORY_BITS) + 1, np.int64)

    def _encode(self, part: str, odd: bool) -> list[int]:
        if odd:
            return self.tokenizer.encode(part, add_special_tokens=False).ids
        return [t.id for t in self.tokenizer.model.tokenize(part.lower().translate(self.letters))]

    def _learn(self, spans: Spans, kinds: np.ndarray, odd: list[bool]) -> np.ndarray:
        each = [self._encode(spans.bytes(i).decode(), o) for i, o in zip(kinds.tolist(), odd, strict=True)]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        begin = self.edges[self.count]
        end = int(begin + sizes.sum())
        while end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[begin:end] = np.fromiter(chain.from_iterable(each), np.uint32, end - begin)
        numbers = np.arange(self.count, self.count + len(kinds))
        self.edges[numbers + 1] = begin + np.cumsum(sizes)
        self.count += len(kinds)
        _, one = np.unique(spans.hashes[kinds], return_index=True)
        self.known.add(spans, kinds[one], numbers[one])
        return numbers

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the ``len + 1`` offsets of the texts."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if not self.splits:
            raw = data.tobytes()
            each = [np.array(self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids, np.uint32) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return np.concatenate(each), np.r_[0, np.cumsum([len(x) for x in each])]
        starts, ends, rows, odd = parts_of(data, offsets)
        spans = Spans(data, starts, ends, hash_words(data, starts, ends, CASED))
        found = self.known.find(spans)
        if (miss := np.flatnonzero(found < 0)).size:
            kinds, back = spans.distinct(miss)
            if self.count + len(kinds) > len(self.edges) * 7 // 10:
                if not self.count:  # one text of that many different parts
                    each = [np.array(self._encode(spans.bytes(i).decode(), o), np.uint32) for i, o in enumerate(odd.tolist())]
                    total = np.r_[0, np.cumsum([len(x) for x in each])]
                    return np.concatenate(each), total[np.searchsorted(rows, np.arange(len(offsets)))]
                self.forget()
                return self.encode(data, offsets)
            found[miss] = self._learn(spans, kinds, odd[kinds].tolist())[back]
        begins = self.edges[found]
        sizes = self.edges[found + 1] - begins
        total = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        pick = np.repeat(begins - total[:-1], sizes) + np.arange(total[-1])
        return self.ids[pick], total[np.searchsorted(rows, np.arange(len(offsets)))]


class SumOfSquares:
    """Open sequences by fill level, and where the next remainder goes."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.open = np.zeros(window + 1, np.int64)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]
        self.places = np.arange(window + 1)

    def level(self, size: int) -> int:
        """The level that minimises the sum of squares; 0 is a new sequence.

        Moving one sequence from level ``h`` to ``h + size`` changes the sum by
        ``2 * (open[h + size] - open[h] + 1)``; a level of 0 or of the full window is not counted.
        """
        counts = self.open
        to = counts[size:] * 2 + 1
        to[-1] = 0  # the window is full
        change = to - 2 * counts[: self.window + 1 - size] + 1
        change[0] = to[0]
        able = counts[: self.window + 1 - size] > 0
        able[0] = True
        return int(np.where(able, change, np.iinfo(np.int64).max).argmin())

    def put(self, size: int, fresh: int) -> tuple[int, int]:
        """The sequence and the offset there of a remainder; ``fresh`` names a new sequence."""
        low = self.level(size)
        sequence = fresh
        if low:
            sequence = self.at[low].pop()
            self.open[low] -= 1
        if low + size < self.window:
            self.at[low + size].append(sequence)
            self.open[low + size] += 1
        return sequence, low


def settle(open_: list[list[tuple]], window: int) -> list[list[tuple]]:
    """Ends the sequences still open without padding: ``key, start, id bytes, document's ids`` pieces by sequence.

    The fullest keep what the rule put there and are filled from the ends of the emptiest.  The one
    that is left over is cut into powers of two.
    """
    size = lambda pieces: sum(len(p[2]) for p in pieces) // 4
    order = sorted(open_, key=size, reverse=True)
    done, low, high = [], 0, len(order) - 1
    while low < high:
        room = window - size(order[low])
        while room and low < high:
            key, start, raw, total = order[high].pop()
            now = min(room, len(raw) // 4)
            if now < len(raw) // 4:
                order[high].append((key, start, raw[: -4 * now], total))
            order[low].append((key, start + len(raw) // 4 - now, raw[-4 * now :], total))
            room -= now
            high -= not order[high]
        if not room:
            done.append(order[low])
            low += 1
    left = order[low] if low == high else []
    while left:
        room, own = 1 << (size(left).bit_length() - 1), []
        while room:
            key, start, raw, total = left.pop(0)
            now = min(room, len(raw) // 4)
            own.append((key, start, raw[: 4 * now], total))
            if now < len(raw) // 4:
                left.insert(0, (key, start + now, raw[4 * now :], total))
            room -= now
        done.append(own)
    return done


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _ready.get(tokenizer_path) or _ready.setdefault(tokenizer_path, WordIds(tokenizer_path))
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        packer, fresh = SumOfSquares(window), 0
        waiting: dict[int, list[tuple]] = {}  # pieces of the open sequences, with their ids
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            rows.clear()
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for part in by_bytes(batches, "text"):
            ids, edges = words.encode(*text_arrays(part.column(1)))
            for i, key in enumerate(part.column(0).to_pylist()):
                own = np.append(ids[edges[i] : edges[i + 1]], np.uint32(end_id)).astype("<u4")
                rest = len(own) % window
                for start in range(0, len(own) - rest, window):
                    crc = zlib.crc32(own[start : start + window].tobytes())
                    rows.append((key, start, window, crc, len(own), base + fresh, 0))
                    fresh += 1
                if rest:
                    sequence, offset = packer.put(rest, fresh)
                    fresh += sequence == fresh
                    waiting.setdefault(sequence, []).append((key, len(own) - rest, own[len(own) - rest :].tobytes(), len(own)))
                    if offset + rest == window:
                        at = 0
                        for k, s, b, n in waiting.pop(sequence):
                            rows.append((k, s, len(b) // 4, zlib.crc32(b), n, base + sequence, at))
                            at += len(b) // 4
            if len(rows) > 20_000:
                yield batch()
        for pieces in settle(list(waiting.values()), window):
            number, offset = base + fresh, 0
            fresh += 1
            for key, start, raw, total in pieces:
                rows.append((key, start, len(raw) // 4, zlib.crc32(raw), total, number, offset))
                offset += len(raw) // 4
        if rows:
            yield batch()

    picked = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return picked.mapInArrow(run, SCHEMA)
