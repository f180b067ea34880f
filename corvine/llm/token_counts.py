"""Token counts by a public subword tokenizer, as lengths only.

Texts go through Arrow in slices of about ``SLICE_BYTES`` bytes, so that a batch of short texts
and one long text cost the same.  Inside a slice every text is cut at safe boundaries: the
SentencePiece vocabulary has no piece in which a word start follows another character, so no merge
crosses a single blank, and the count of a text is the sum of the counts of its blank-separated
segments.  Equal segments of a slice are encoded once, and a bounded table keeps the counts of
segments seen before, confirmed by their bytes.  Vocabularies for which the rule does not hold are encoded as whole texts.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows each get a row; an
empty table gives an empty result; columns other than the two named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._common import BLANK, CASED, Spans, SpanTable, by_bytes, find_words, hash_words, text_arrays

#: Size of the table of segments whose counts a Python worker remembers; when full it starts anew.
MEMORY_BITS = 21
MARK = "\u2581".encode()
_ready: dict[str, SegmentCounter] = {}


class SegmentCounter:
    """Exact token counts of texts under one SentencePiece model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces) and len(self.encode(["a  b "])[0]) == 4
        self.forget()

    def forget(self) -> None:
        self.known, self.of, self.used = SpanTable(MEMORY_BITS), np.zeros(1 << MEMORY_BITS, np.int64), 0

    def encode(self, texts: list) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        raw = data.tobytes()
        whole = lambda rows: [len(x) for x in self.encode([raw[offsets[i] : offsets[i + 1]].decode() for i in rows])]
        if not self.splits:
            return np.array(whole(range(len(offsets) - 1)), np.int64)
        starts, ends, rows = find_words(data, offsets, BLANK)
        out = np.zeros(len(offsets) - 1, np.int64)
        words = np.bincount(rows, minlength=len(out))
        single = (words == 0) & (offsets[1:] > offsets[:-1])
        if raw.find(MARK) >= 0:  # the mark that stands for a blank, written in a text itself
            single |= [raw.find(MARK, a, b) >= 0 for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        if (rest := np.flatnonzero(single).tolist()):
            own = whole(rest)
        if not len(starts):
            out[rest] = own if rest else 0
            return out
        first = np.r_[True, rows[1:] != rows[:-1]]
        begins = np.where(first, offsets[rows], np.r_[0, ends[:-1]] + 1)
        spans = Spans(data, begins, ends, hash_words(data, begins, ends, CASED))
        number = self.known.find(spans)
        found = self.of[np.maximum(number, 0)]
        if (miss := np.flatnonzero(number < 0)).size:
            kinds, back = spans.distinct(miss)
            new = np.array([len(x) for x in self.encode([spans.bytes(i).decode() for i in kinds.tolist()])], np.int64)
            found[miss] = new[back]
            if not self.known.slots.room(len(kinds)):
                self.forget()
            if self.known.slots.room(len(kinds)):
                numbers = self.used + np.arange(len(kinds))
                self.of[numbers], self.used = new, self.used + len(kinds)
                _, one = np.unique(spans.hashes[kinds], return_index=True)
                self.known.add(spans, kinds[one], numbers[one])
        out += np.bincount(rows, found, len(out)).astype(np.int64)
        last = np.flatnonzero(np.r_[rows[1:] != rows[:-1], True])
        tail = offsets[rows[last] + 1] - ends[last]
        ending = (1 if n == 1 else len(self.encode([" " * (n - 1)])[0]) for n in tail[tail > 0].tolist())
        out[rows[last[tail > 0]]] += np.fromiter(ending, np.int64)
        if rest:
            out[rest] = own
        return out


def count_tokens(docs: DataFrame, model_path: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``; no shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _ready.get(model_path) or _ready.setdefault(model_path, SegmentCounter(model_path))
        for part in by_bytes(batches, "text"):
            data, offsets = text_arrays(part.column(1))
            tokens = pa.array(counter.counts(data, offsets))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(offsets)), tokens, pc.greater(tokens, limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    picked = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return picked.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
