"""Alignment of the tokens of two tokenizers over the same bytes, by a sweep over their end events.

Both tokenizers encode a space and the text; a token stands for its bytes, and its end offset is an event.  Events of both sides leave
the encoding tasks as one union, packed in blocks of ids (the ends follow from the ids' sizes); they are
repartitioned by document and sorted by offset, and a machine reads them as a stream.  Wherever both sides end at
the same offset a *group* closes.  The machine keeps the tokens of the open group, the running digest and counts of the open document, and that
document's distinct id pairs, whatever the length of the text.  A pair's count is the number of documents that hold it
linked; the counts return to the documents from a broadcast table, or, beyond ``MOST_PAIRS`` counted pairs,
by a join in which only hot pairs are broadcast.

Encoding cuts texts into segments at blanks where neither tokenizer can have a token across (``cuts``), and remembers the ids
of segments up to ``REMEMBERED`` bytes, confirmed by their bytes.

Defined results: null and empty texts, and texts whose tokens on either side do not join to the space and the text, have no tokens:
zeros and an empty digest; repeated rows are documents of their own; an empty table gives no rows; columns other than the two named
are not read.  Rows must come in the same order when read again, as a scan's do; checkpoint others first.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import CASED, Spans, SpanTable, by_bytes, hash_words, kept, spread_join, text_arrays

#: Segments a worker remembers a side (as a power of 2), their size at most, tokens of one event block, events of one sweep step.
MEMORY_BITS, REMEMBERED, BLOCK_TOKENS, STEP_EVENTS = 19, 64, 1 << 15, 1 << 18
#: Links of a group beyond which its ids are counted before they are paired; distinct pairs that may be broadcast.
WIDE_LINKS, MOST_PAIRS = 4096, 4_000_000
#: Ids are below this for both tokenizers.
IDS = 1 << 16
MARK = "▁".encode()
_ready: dict[tuple, object] = {}


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteLevel:
    """A byte-level BPE of the ``tokenizers`` library; special strings are plain text."""

    def __init__(self, path: str) -> None:
        import tokenizers

        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        letters = byte_letters()
        self.model = tokenizers.Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()

    def encode(self, parts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]

    def cuts(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """A blank begins a new piece if it follows or precedes a printable ASCII character: runs of white space leave their last blank to the word."""
        printable = lambda b: (b > 0x20) & (b < 0x7F)
        return printable(before) | printable(after)


class Pieces:
    """A SentencePiece model that writes a blank as U+2581 and puts one before the text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.encode().replace(MARK, b" ") for i, p in enumerate(pieces)]
        self.blank = self.model.piece_to_id("▁")
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, parts: list[bytes]) -> list[list[int]]:
        return [ids if p != b" " else [self.blank] for p, ids in zip(parts, self.model.encode([p[1:].decode() for p in parts], num_threads=1), strict=True)]

    def cuts(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """No piece holds a blank after another character, so none crosses the first blank of a run."""
        return before != 0x20 if self.splits else np.zeros(len(before), bool)


@dataclass
class Encoder:
    """Ids of whole texts by way of remembered segments."""

    side: ByteLevel | Pieces

    def __post_init__(self) -> None:
        self.sizes = np.array([len(b) for b in self.side.bytes], np.int64)
        self.forget()

    def forget(self) -> None:
        self.known, self.used = SpanTable(MEMORY_BITS), 0
        self.at, self.count, self.sound = np.zeros(1 << MEMORY_BITS, np.int64), np.zeros(1 << MEMORY_BITS, np.int64), np.zeros(1 << MEMORY_BITS, bool)
        self.pool, self.filled = np.zeros(1 << MEMORY_BITS, np.uint16), 0

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For nonempty texts that begin with a space: ids of all, tokens of each, and whether each one's tokens join to it."""
        blank = np.flatnonzero(data == 0x20)
        inner = blank[~np.isin(blank, offsets[:-1], assume_unique=True)]
        after = np.where(np.isin(inner + 1, offsets), 0, data[np.minimum(inner + 1, len(data) - 1)])
        starts = np.sort(np.r_[offsets[:-1], inner[self.side.cuts(data[inner - 1], after)]])
        ends = np.r_[starts[1:], len(data)]
        rows = np.searchsorted(offsets, starts, "right") - 1
        spans = Spans(data, starts, ends, hash_words(data, starts, ends, CASED))
        number = self.known.find(spans)
        at, count, sound = self.at[np.maximum(number, 0)], self.count[np.maximum(number, 0)], self.sound[np.maximum(number, 0)]
        pool = self.pool
        if (miss := np.flatnonzero(number < 0)).size:
            kinds, back = spans.distinct(miss)
            parts = [spans.bytes(i) for i in kinds.tolist()]
            made = self.side.encode(parts)
            words = self.side.bytes
            good = np.array([b"".join([words[i] for i in ids]) == p for ids, p in zip(made, parts, strict=True)], bool)
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            flat = np.fromiter((i for ids in made for i in ids), np.uint16, int(sizes.sum()))
            begins = np.cumsum(sizes) - sizes
            at[miss], count[miss], sound[miss] = self.filled + begins[back], sizes[back], good[back]
            pool = np.r_[self.pool[: self.filled], flat]
            self.remember(spans, kinds, flat, begins, sizes, good)
        tokens = np.cumsum(count)
        ids = pool[np.repeat(at - (tokens - count), count) + np.arange(tokens[-1])]
        of_row = np.bincount(rows, count, len(offsets) - 1).astype(np.int64)
        return ids, of_row, np.bincount(rows, ~sound, len(offsets) - 1) == 0

    def remember(self, spans: Spans, kinds: np.ndarray, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, good: np.ndarray) -> None:
        _, one = np.unique(spans.hashes[kinds], return_index=True)
        one = one[spans.size[kinds[one]] <= REMEMBERED]
        if not self.known.slots.room(len(one)):
            self.forget()
        if not self.known.slots.room(len(one)):
            return
        n = self.used + np.arange(len(one))
        self.used += len(one)
        room = np.cumsum(sizes[one])
        total = int(room[-1]) if len(room) else 0
        while self.filled + total > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros_like(self.pool)]
        self.at[n], self.count[n], self.sound[n] = self.filled + room - sizes[one], sizes[one], good[one]
        self.pool[self.filled : self.filled + total] = flat[np.repeat(begins[one] - (room - sizes[one]), sizes[one]) + np.arange(total)]
        self.filled += total
        self.known.add(spans, kinds[one], n)


def encoders(path_a: str, path_b: str) -> tuple[Encoder, Encoder]:
    key = (path_a, path_b)
    if key not in _ready:
        sides = tuple(Encoder((Pieces if p.endswith(".model") else ByteLevel)(p)) for p in key)
        if max(len(s.sizes) for s in sides) > IDS:
            raise ValueError(f"ids of {IDS} and more")
        _ready[key] = sides
    return _ready[key]


EVENTS = "row long, doc_id long, at long, side int, ids binary"


def events(docs: DataFrame, path_a: str, path_b: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of end events of both sides.  Each document has a first block of side 0, which is empty where it has no tokens."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = encoders(path_a, path_b)
        for part in by_bytes(batches, "text"):
            data, offsets = text_arrays(part.column(2))
            full = np.flatnonzero(np.diff(offsets))
            sound, made = np.ones(len(full), bool), []
            if full.size:
                starts = offsets[full]
                spaced, edges = np.insert(data, starts, 0x20), np.r_[starts + np.arange(len(full)), len(data) + len(full)]
                for side in sides:
                    ids, tokens, good = side.ids(spaced, edges)
                    made.append((ids, np.r_[0, np.cumsum(tokens)]))
                    sound &= good
            out: dict[str, list] = {"nth": [], "at": [], "side": [], "ids": []}

            def block(nth: int, at: int, side: int, ids: bytes, out: dict[str, list] = out) -> None:
                for key, value in zip(out, (nth, at, side, ids), strict=True):
                    out[key].append(value)

            for nth in np.setdiff1d(np.arange(part.num_rows), full[sound]).tolist():
                block(nth, 0, 0, b"")
            for k in np.flatnonzero(sound).tolist():
                for side, (ids, edges) in enumerate(made):
                    a, b = int(edges[k]), int(edges[k + 1])
                    at = 0
                    for c in range(a, b, block_tokens):
                        cut = ids[c : min(b, c + block_tokens)]
                        block(int(full[k]), at, side, cut.tobytes())
                        at += int(sides[side].sizes[cut].sum()) if b - a > block_tokens else 0
            pick = pa.array(out["nth"], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(pick), part.column(1).take(pick), pa.array(out["at"], pa.int64()), pa.array(out["side"], pa.int32()), pa.array(out["ids"], pa.binary())], ["row", "doc_id", "at", "side", "ids"])

    return docs.mapInArrow(encode, EVENTS)


def places(edges_from: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers ``from, from + 1, ...`` of each stretch, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(edges_from - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def digits() -> tuple[np.ndarray, np.ndarray]:
    """Each id's decimal digits, from the left, and how many they are."""
    numbers = np.arange(IDS)
    size = np.char.str_len(numbers.astype(str)).astype(np.int64)
    return np.frombuffer(np.char.encode(np.char.ljust(numbers.astype(str), 6)).tobytes(), np.uint8).reshape(IDS, 6), size


@dataclass
class Document:
    """What the machine keeps of an open document."""

    row: int
    doc_id: int | None
    n: np.ndarray = field(default_factory=lambda: np.zeros(4, np.int64))  # tokens of A and B, groups, links
    at: int = 0
    text: object = None
    pairs: list = field(default_factory=list)
    waiting: tuple = ((), ())

    def put(self, pairs: np.ndarray, times: np.ndarray) -> None:
        self.pairs.append((pairs, times))
        if len(self.pairs) > 8:
            self.pairs = [self.all_pairs()]

    def all_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pairs) == 1:
            return self.pairs[0]
        if not self.pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs, times = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
        kinds, back = np.unique(pairs, return_inverse=True)
        return kinds, np.bincount(back, times).astype(np.int64)


class Machine:
    """Reads blocks in the order of document and offset and closes groups; ``step`` works on what has come so far."""

    def __init__(self, sizes: tuple[np.ndarray, np.ndarray]) -> None:
        self.sizes, self.docs, self.blocks, self.held = sizes, [], [], 0
        self.figures, self.lengths = digits()

    def take(self, row: int, doc_id: int | None, side: int, ids: bytes) -> None:
        if not self.docs or self.docs[-1].row != row:
            self.docs.append(Document(row, doc_id, text=sha256()))
            self.blocks.append(([], []))
        if ids:
            cut = np.frombuffer(ids, np.uint16)
            self.blocks[-1][side].append(cut)
            self.held += len(cut)

    def groups(self, last: bool) -> tuple | None:
        """Closes all groups it can; the tail of the last document waits unless it is ``last``."""
        if not self.docs:
            return None
        flat, tokens = [], []
        for side in (0, 1):
            parts = [[w] if len(w := d.waiting[side]) else [] for d in self.docs]
            parts = [p + b[side] for p, b in zip(parts, self.blocks, strict=True)]
            tokens.append(np.array([sum(map(len, p)) for p in parts], np.int64))
            flat.append(np.concatenate([x for p in parts for x in p] or [np.zeros(0, np.uint16)]))
        (a, b), (ends_a, ends_b) = flat, (np.cumsum(s[f]) for s, f in zip(self.sizes, flat, strict=True))
        spot = np.searchsorted(ends_b, ends_a)
        common = ends_b[np.minimum(spot, len(ends_b) - 1)] == ends_a if len(ends_b) else np.zeros(len(ends_a), bool)
        at = np.flatnonzero(common)
        closed_a, closed_b = (int(at[-1]) + 1, int(spot[at[-1]]) + 1) if len(at) else (0, 0)
        edges_a, edges_b = np.r_[0, at + 1], np.r_[0, spot[at] + 1]
        group_doc = np.searchsorted(np.cumsum(tokens[0]), at, "right")
        rest = (a[closed_a:], b[closed_b:])
        self.blocks, self.held = [([], []) for _ in self.docs], 0
        self.docs[-1].waiting = rest
        if last and (len(rest[0]) or len(rest[1])):
            raise ValueError(f"row {self.docs[-1].row}: the sides end apart")
        return a[:closed_a], b[:closed_b], edges_a, edges_b, group_doc, ends_a[at]

    def count(self, made: tuple) -> None:
        """Adds the closed groups to their documents: counts, digest, pairs."""
        a, b, edges_a, edges_b, doc, _ = made
        docs, n_a, n_b = len(self.docs), np.diff(edges_a), np.diff(edges_b)
        if not len(doc):
            return
        sums = [np.bincount(doc, w, docs).astype(np.int64) for w in (n_a, n_b, np.ones_like(n_a), n_a * n_b)]
        text, ends = self.text(a, b, n_a, n_b)
        first = np.searchsorted(doc, np.arange(docs + 1))
        cuts = np.r_[0, ends][first]
        for k, d in enumerate(self.docs):
            if first[k] < first[k + 1]:
                piece = text[cuts[k] : cuts[k + 1]]
                d.text.update(piece if d.n[2] else piece[1:])
                d.n += [s[k] for s in sums]
        codes, times, of = self.pairs(a, b, edges_a, edges_b, n_a, n_b, doc)
        keys, back = np.unique(of * IDS * IDS + codes, return_inverse=True)
        total = np.bincount(back, times).astype(np.int64)
        cuts = np.searchsorted(keys, np.arange(docs + 1) * IDS * IDS)
        for k, d in enumerate(self.docs):
            if cuts[k] < cuts[k + 1]:
                d.put(keys[cuts[k] : cuts[k + 1]] - k * IDS * IDS, total[cuts[k] : cuts[k + 1]])

    def pairs(self, a, b, edges_a, edges_b, n_a, n_b, doc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Id pairs of all groups with their links and documents; ids of wide groups are counted before they are paired."""
        wide = n_a * n_b > WIDE_LINKS
        group = np.repeat(np.arange(len(n_a)), n_a)
        group = group[~wide[group]]
        near = a[np.repeat(~wide, n_a)].astype(np.int64)
        codes = [np.repeat(near, n_b[group]) * IDS + b[places(edges_b[group], n_b[group])]]
        times, of = [np.ones(len(codes[0]), np.int64)], [np.repeat(doc[group], n_b[group])]
        for g in np.flatnonzero(wide).tolist():
            one, m = np.unique(a[edges_a[g] : edges_a[g + 1]], return_counts=True)
            two, n = np.unique(b[edges_b[g] : edges_b[g + 1]], return_counts=True)
            codes.append((one.astype(np.int64)[:, None] * IDS + two).ravel())
            times.append((m[:, None] * n).ravel())
            of.append(np.full(len(one) * len(two), doc[g]))
        return tuple(np.concatenate(x) for x in (codes, times, of))

    def text(self, a, b, n_a, n_b) -> tuple[bytes, np.ndarray]:
        """``;a1,a2|b1`` of all groups, and where each ends."""
        order_a, order_b = places(np.cumsum(n_a + n_b) - n_a - n_b, n_a), places(np.cumsum(n_a + n_b) - n_b, n_b)
        ids, before = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[order_a], ids[order_b] = a, b
        starts = np.cumsum(n_a + n_b) - n_a - n_b
        before[starts], before[starts + n_a] = ord(";"), ord("|")
        size = self.lengths[ids] + 1
        ends = np.cumsum(size)
        out = np.zeros(int(ends[-1]), np.uint8)
        out[ends - size] = before
        for k in range(5):
            has = np.flatnonzero(size > k + 1)
            out[(ends - size)[has] + 1 + k] = self.figures[ids[has], k]
        return out.tobytes(), ends[np.cumsum(n_a + n_b) - 1]

    def closed(self, last: bool) -> list[Document]:
        """Takes out the documents that are finished: all but the last, or all."""
        cut = len(self.docs) if last else len(self.docs) - 1
        out, self.docs, self.blocks = self.docs[:cut], self.docs[cut:], self.blocks[cut:]
        return out


def pack(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted pairs as steps with their links, bytes of equal weight together, compressed."""
    raw = np.r_[np.diff(pairs, prepend=0), np.minimum(times, 0xFFFFFFFF)].astype("<u4")
    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(raw.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(stored: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(stored), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
    return np.cumsum(raw[: len(raw) // 2]), raw[len(raw) // 2 :]


def swept(sorted_events: DataFrame, sizes: Callable[[], tuple], emit: Callable, schema: str, step_events: int) -> DataFrame:
    """Runs the machine over sorted blocks; ``emit`` makes batches of the closed groups and the closed documents."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(sizes())

        def step(last: bool) -> Iterator[pa.RecordBatch]:
            if made := machine.groups(last):
                machine.count(made)
                docs = machine.docs
                yield from emit(made, docs, machine.closed(last))

        for batch in batches:
            for row, doc_id, _, side, ids in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                machine.take(row, doc_id, side, ids)
                if machine.held >= step_events:
                    yield from step(False)
        yield from step(True)

    return sorted_events.mapInArrow(sweep, schema)


def sorted_events(docs: DataFrame, path_a: str, path_b: str, doc_id: str, text: str, block_tokens: int) -> DataFrame:
    picked = docs.select(F.monotonically_increasing_id().alias("row"), docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return events(picked, path_a, path_b, block_tokens).repartition("row").sortWithinPartitions("row", "at", "side")


SWEPT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"
COUNTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", most_pairs: int = MOST_PAIRS, block_tokens: int = BLOCK_TOKENS, step_events: int = STEP_EVENTS) -> DataFrame:
    """Per document the numbers of tokens, groups and links, the digest of its groups, and how its links stand in the corpus (``COUNTS``)."""

    def documents(_made: tuple, _docs: list, done: list[Document]) -> Iterator[pa.RecordBatch]:
        if not done:
            return
        counts = np.array([d.n for d in done]).T
        names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"]
        columns = [[d.row for d in done], [d.doc_id for d in done], *counts, [d.text.hexdigest() if d.n[2] else "" for d in done], [pack(*d.all_pairs()) for d in done]]
        kinds = [pa.int64()] * 6 + [pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def tables() -> tuple:
        return tuple(s.sizes for s in encoders(path_a, path_b))

    found = kept(swept(sorted_events(docs, path_a, path_b, doc_id, text, block_tokens), tables, documents, SWEPT, step_events))
    pairs = kept(count_pairs(found))
    if pairs.count() <= most_pairs:
        return by_table(found, pairs)
    top = pairs.groupBy(F.floor(F.col("pair") / IDS).alias("a")).agg(F.max("n").alias("best"))  # at most one row an id of A
    known = pairs.join(F.broadcast(top), F.floor(F.col("pair") / IDS) == F.col("a")).select("pair", "n", (F.col("n") == F.col("best")).alias("is_best"))
    spread = found.select("row", "pairs").mapInArrow(spread_pairs, "row long, pair long, times long")
    met = spread_join(spread, known.withColumn("w", F.col("n")), "pair", "w", most=0)
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = found.drop("pairs").join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"])
    return out.select([c.split()[0] for c in COUNTS.split(", ")])


def spread_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            pairs, times = unpack(stored)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), row)), pa.array(pairs), pa.array(times)], ["row", "pair", "times"])


def count_pairs(found: DataFrame) -> DataFrame:
    """Documents that hold each pair, added up within batches before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.RecordBatch:
            kinds, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n.astype(np.int64))], ["pair", "n"])

        for batch in batches:
            for stored in batch.column(0).to_pylist():
                held.append(unpack(stored)[0])
                size += len(held[-1])
                if size >= 1 << 21:
                    yield summed()
                    held, size = [], 0
        if held:
            yield summed()

    return found.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def by_table(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Looks each document's pairs up in a broadcast table of all pairs, whose number has been checked."""
    table = pairs.toArrow()
    kinds, n = (np.asarray(table.column(c).combine_chunks()) for c in ("pair", "n"))
    order = np.argsort(kinds)
    kinds, n = kinds[order], n[order]
    edges = np.flatnonzero(np.diff(kinds // IDS, prepend=-1))
    top = np.repeat(np.maximum.reduceat(n, edges), np.diff(np.r_[edges, len(n)])) if len(n) else n
    shared = found.sparkSession.sparkContext.broadcast((kinds, n, n == top))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, n, best = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [unpack(s) for s in batch.column(6).to_pylist()]
            rows = np.repeat(np.arange(len(parts)), [len(p) for p, _ in parts])
            at, times = np.searchsorted(kinds, np.concatenate([p for p, _ in parts])), np.concatenate([t for _, t in parts])
            sums = [np.zeros(len(parts), np.int64) for _ in range(2)]
            np.add.at(sums[0], rows, times * best[at] if len(at) else times)
            np.add.at(sums[1], rows, times * n[at] if len(at) else times)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sums[0]), pa.array(sums[1]), batch.column(5)], [c.split()[0] for c in COUNTS.split(", ")])

    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs").mapInArrow(look, COUNTS)


GROUPS = "row long, doc_id long, start long, end long, a_ids array<int>, b_ids array<int>"


def token_groups(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS, step_events: int = STEP_EVENTS) -> DataFrame:
    """The groups themselves: byte range (counted from the space before the text) and the ids of both sides."""

    def groups(made: tuple, docs_: list, _done: list) -> Iterator[pa.RecordBatch]:
        a, b, edges_a, edges_b, doc, ends = made
        if not len(doc):
            return
        begins = np.r_[0, ends[:-1]]
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        base = np.zeros(len(docs_), np.int64)
        base[doc[first]] = begins[first]
        had = np.array([d.at for d in docs_], np.int64)
        lists = [pa.ListArray.from_arrays(pa.array(e.astype(np.int32)), pa.array(x.astype(np.int32))) for e, x in ((edges_a, a), (edges_b, b))]
        ids = pa.array([d.doc_id for d in docs_], pa.int64()).take(pa.array(doc))
        shift = had[doc] - base[doc]
        yield pa.RecordBatch.from_arrays([pa.array(np.array([d.row for d in docs_])[doc]), ids, pa.array(begins + shift), pa.array(ends + shift), *lists], ["row", "doc_id", "start", "end", "a_ids", "b_ids"])
        for k in np.unique(doc).tolist():
            docs_[k].at += int(ends[doc == k][-1] - base[k])

    return swept(sorted_events(docs, path_a, path_b, doc_id, text, block_tokens), lambda: tuple(s.sizes for s in encoders(path_a, path_b)), groups, GROUPS, step_events)
