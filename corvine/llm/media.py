"""Media columns: what binary values really are, and what they carry inside.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a value; a match
counts only when the format's validator confirms structure and length from the bytes there.  The
format confirmed at offset 0 corrects the declared type; formats confirmed further in are carved
out, outermost first, so carved parts do not overlap.

``to_wave`` and ``from_wave`` are the lossless container of the query: 8-bit mono samples.

The work on a value grows with its length however many magic bytes it has: walks from block to block remember
where they failed, and ends, headers and directories are listed once a value.  Only gzip members are tried
anew from each magic, up to their first error.

Defined results: a null value is empty and of type ``application/octet-stream`` like any value that
no validator accepts; equal values give equal results whatever their row; an empty table gives an empty result;
the columns ``keys`` come back as they are and must not be named as the new ones, which is an error.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cached_property

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

UNKNOWN = "application/octet-stream"


class Value:
    """The bytes of one value, and what its validators have found out about places in it.

    ``dead`` remembers, for a walk by format, the places from which it has failed before, so that walks from many
    magic bytes that run together cost what one walk costs.
    """

    def __init__(self, data: bytes) -> None:
        self.raw, self.b = data, memoryview(data)
        self._dead: dict[str, bytearray] = {}

    def __len__(self) -> int:
        return len(self.raw)

    def walk(self, name: str, step: Callable[[int], int], place: int) -> int:
        """``step`` from place to place until it gives an end (as ``-1 - end``); 0 if it fails (``len`` or beyond)."""
        if name not in self._dead:
            self._dead[name] = bytearray(len(self) + 1)
        dead = self._dead[name]
        seen = []
        while 0 <= place < len(self) and not dead[place]:
            seen.append(place)
            place = step(place)
        if place < 0:
            return -1 - place
        for at in seen:
            dead[at] = 1
        return 0

    @cached_property
    def last_jpeg_end(self) -> int:
        return self.raw.rfind(b"\xff\xd9")

    @cached_property
    def archives(self) -> dict[int, int]:
        """Ends of all zip archives by their starts, the longest of a start."""
        found: dict[int, int] = {}
        for m in re.compile(rb"PK\x05\x06").finditer(self.raw):
            if place := _directory(self.b, m.start()):
                found[place[0]] = max(place[1], found.get(place[0], 0))
        return found

    @cached_property
    def pdf_heads(self) -> list[int]:
        return [m.start() for m in _PDF_HEAD.finditer(self.raw)]

    @cached_property
    def pdf_ends(self) -> list[tuple[int, int, int]]:
        """Of each end: where it begins and ends, and the place it gives for its cross-references."""
        return [(m.start(), m.end(), int(m[1])) for m in _PDF_END.finditer(self.raw)]

    @cached_property
    def pdf_tables(self) -> dict[int, int]:
        """Places that may be given for cross-references: they begin there or behind white space."""
        found = {}
        for m in _PDF_TABLE.finditer(self.raw):
            at = m.start()
            if m[0][:1] != b"x" and not _PDF_STREAM.search(self.raw, m.end(), m.end() + 2048):
                continue
            found[at] = at
            while at and self.raw[at - 1] in b" \t\r\n\0\x0c" and at - 1 not in found:
                at -= 1
                found[at] = at
        return found

    @cached_property
    def pdf_own(self) -> dict[int, int]:
        """The last end of each header whose cross-references lie between it and the end before."""
        heads, found, before = set(self.pdf_heads), {}, 0
        tables = sorted(self.pdf_tables)
        k = 0
        for start, end, given in self.pdf_ends:
            while k < len(tables) and tables[k] < start:
                if (at := tables[k] - given) in heads and tables[k] >= before and at < tables[k]:
                    found[at] = end
                k += 1
            before = end
        return found


def _png(v: Value, at: int) -> int:
    def chunk(place: int) -> int:
        if place + 12 > len(v):
            return len(v)
        size, kind = struct.unpack_from(">I4s", v.b, place)
        end = place + 12 + size
        if end > len(v) or not kind.isalpha() or zlib.crc32(v.b[place + 4 : end - 4]) != struct.unpack_from(">I", v.b, end - 4)[0]:
            return len(v)
        return -1 - end if kind == b"IEND" else end

    first = at + 8
    if v.raw[first : first + 8] != b"\0\0\0\rIHDR" or chunk(first) == len(v):
        return 0
    return max(v.walk("png", chunk, first + 25) - at, 0)


def _riff(form: bytes, first: bytes) -> Callable[[Value, int], int]:
    def check(v: Value, at: int) -> int:
        b = v.b
        if at + 20 > len(b) or bytes(b[at + 8 : at + 12]) != form:
            return 0
        size = struct.unpack_from("<I", b, at + 4)[0] + 8
        if not 20 <= size <= len(b) - at or not bytes(b[at + 12 : at + 16]).startswith(first):
            return 0
        place = at + 12
        while place + 8 <= at + size:
            place += 8 + (n := struct.unpack_from("<I", b, place + 4)[0]) + n % 2
        return size if place in (at + size, at + size + 1) else 0

    return check


def _gif(v: Value, at: int) -> int:
    b, n = v.b, len(v)
    if at + 13 > n:
        return 0

    def block(place: int) -> int:
        """From the place of a block, or of a part of one (kept apart by ``n``), to the next block."""
        if b[place] == 0x3B:
            return -2 - place
        if b[place] == 0x21:
            place += 2
        elif b[place] == 0x2C and place + 10 < n:
            place += 11 + (3 << (b[place + 9] & 7) + 1 if b[place + 9] & 128 else 0)
        else:
            return n
        end = v.walk("gif parts", part, place)
        return end if end else n

    def part(place: int) -> int:
        return place + b[place] + 1 if b[place] else -2 - place

    place = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)
    return max(v.walk("gif", block, place) - at, 0)


def _bmp(v: Value, at: int) -> int:
    if at + 30 > len(v):
        return 0
    size, zero, start, header, _, _, planes, depth = struct.unpack_from("<IIIIiiHH", v.b, at + 2)
    fits = zero == 0 and header in (12, 40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32)
    return size if fits and 14 + header <= start <= size <= len(v) - at else 0


def _jpeg(v: Value, at: int) -> int:
    def segment(place: int) -> int:
        if place + 4 > len(v) or v.b[place] != 0xFF:
            return len(v)
        kind, size = v.b[place + 1], struct.unpack_from(">H", v.b, place + 2)[0]
        if not 0xC0 <= kind <= 0xFE or size < 2 or 0xD0 <= kind <= 0xD9:
            return len(v)
        place += 2 + size
        if kind != 0xDA:
            return place
        return -3 - v.raw.find(b"\xff\xd9", place) if place <= v.last_jpeg_end else len(v)

    return max(v.walk("jpeg", segment, at + 2) - at, 0)


def _gzip(v: Value, at: int) -> int:
    b = v.b
    if at + 18 > len(b) or b[at + 2] != 8 or b[at + 3] & 0xE0:
        return 0
    engine, place = zlib.decompressobj(31), at
    try:
        while place < len(b) and not engine.eof:
            part = b[place : place + 65536]
            while len(part) and not engine.eof:  # a bounded piece of output at a time
                engine.decompress(part, 1 << 20)
                part = engine.unconsumed_tail
            place += 65536
    except zlib.error:
        return 0
    return min(place, len(b)) - at - len(engine.unused_data) if engine.eof else 0


#: How PDF files begin and end, and what their cross-references look like.
_PDF_HEAD, _PDF_END = re.compile(rb"%PDF-[12]\.\d[\r\n ]"), re.compile(rb"startxref\s+(\d{1,18})\s+%%EOF")
_PDF_TABLE, _PDF_STREAM = re.compile(rb"(?<!start)xref\s|(?<!\d)\d{1,10}\s{1,4}\d{1,5}\s{1,4}obj\s{0,4}<<"), re.compile(rb"/Type\s{0,4}/XRef")


def _pdf(v: Value, at: int) -> int:
    """Up to the file's own last end: one whose cross-references are the file's.

    They lie between the end before and this one, also in an update, whatever files the update holds.  In a file
    laid out for the web the second end gives a place before the first, and no other header stands between them.
    Without any such end it is the last one before the next header.
    """
    heads, ends = v.pdf_heads, v.pdf_ends
    k = bisect_left(heads, at)
    if k == len(heads) or heads[k] != at:
        return 0
    following = heads[k + 1] if k + 1 < len(heads) else len(v)
    e = bisect_left(ends, (at,))
    own = v.pdf_own.get(at, 0)
    if e + 1 < len(ends) and ends[e + 1][0] < following and at < at + ends[e + 1][2] < ends[e][0] and at + ends[e + 1][2] in v.pdf_tables:
        own = max(own, ends[e + 1][1])
    if not own:
        last = bisect_left(ends, (following,)) - 1
        own = ends[last][1] if last >= e and ends[last][1] <= following else 0
    return max(own - at, 0)


def _wide(b: memoryview, extra: int, size: int, skip: int) -> int | None:
    """The value at ``skip`` of the zip64 field among extra fields."""
    end = extra + size
    while extra + 4 <= end:
        kind, n = struct.unpack_from("<HH", b, extra)
        if kind == 1:
            return struct.unpack_from("<Q", b, extra + 4 + skip)[0] if skip + 8 <= n and extra + 4 + n <= end else None
        extra += 4 + n
    return None


def _directory(b: memoryview, end: int) -> tuple[int, int] | None:
    """Start and end of the archive whose end-of-central-directory record is at ``end``, if its members are there."""
    if end + 22 > len(b):
        return None
    entries, size, offset, comment = struct.unpack_from("<HIIH", b, end + 10)
    close, stop = end, end + 22 + comment
    if end >= 76 and bytes(b[end - 20 : end - 16]) == b"PK\6\7" and bytes(b[end - 76 : end - 72]) == b"PK\6\6":
        close = end - 76
        entries, size, offset = struct.unpack_from("<QQQ", b, close + 32)
    place, base = close - size, close - size - offset
    if not entries or base < 0 or stop > len(b):
        return None
    first, directory = place, place
    for _ in range(entries):
        if place + 46 > close or bytes(b[place : place + 4]) != b"PK\1\2":
            return None
        packed, full, name, extra, note = struct.unpack_from("<IIHHH", b, place + 20)
        begin = struct.unpack_from("<I", b, place + 42)[0]
        fields, skip = place + 46 + name, 8 * (full == 0xFFFFFFFF)
        if packed == 0xFFFFFFFF:
            packed, skip = _wide(b, fields, extra, skip), skip + 8
        if begin == 0xFFFFFFFF:
            begin = _wide(b, fields, extra, skip)
        if packed is None or begin is None:
            return None
        begin += base
        if begin + 30 > directory or bytes(b[begin : begin + 4]) != b"PK\3\4" or begin + 30 + sum(struct.unpack_from("<HH", b, begin + 26)) + packed > directory:
            return None
        first, place = min(first, begin), place + 46 + name + extra + note
    return (first, stop) if place == close else None


def _zip(v: Value, at: int) -> int:
    """The central directory has the members' sizes, also where their headers leave them to descriptors."""
    return v.archives.get(at, at) - at


#: Magic bytes of the formats, with the media type and the validator of each.
FORMATS: dict[bytes, tuple[str, Callable[[Value, int], int]]] = {
    b"\x89PNG\r\n\x1a\n": ("image/png", _png),
    b"\xff\xd8\xff": ("image/jpeg", _jpeg),
    b"GIF87a": ("image/gif", _gif),
    b"GIF89a": ("image/gif", _gif),
    b"BM": ("image/bmp", _bmp),
    b"RIFF": ("audio/wav", _riff(b"WAVE", b"fmt ")),
    b"\x1f\x8b": ("application/gzip", _gzip),
    b"%PDF-": ("application/pdf", _pdf),
    b"PK\x03\x04": ("application/zip", _zip),
}
RIFF_KINDS = (("audio/wav", FORMATS[b"RIFF"][1]), ("image/webp", _riff(b"WEBP", b"VP8")), ("video/x-msvideo", _riff(b"AVI ", b"LIST")))
_automaton: list[ahocorasick.Automaton] = []


def _search() -> ahocorasick.Automaton:
    if not _automaton:
        made = ahocorasick.Automaton()
        for magic in FORMATS:
            made.add_word(magic.decode("latin-1"), magic)
        made.make_automaton()
        _automaton.append(made)
    return _automaton[0]


def confirm(value: Value, at: int, magic: bytes) -> tuple[str, int]:
    """Media type and length of what begins at ``at``; length 0 if the validator rejects it."""
    kinds = RIFF_KINDS if magic == b"RIFF" else (FORMATS[magic],)
    return next(((kind, n) for kind, check in kinds if (n := check(value, at))), (UNKNOWN, 0))


def sniff(value: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The media type of a value, and what is carved from it as ``(type, offset, length)``.

    A file that fills the whole value is opened: what lies inside is carved.  Elsewhere the search
    goes on after the end of what was carved.
    """
    kind, carved, free = UNKNOWN, [], 0
    view = Value(bytes(value))
    for last, magic in _search().iter(value.decode("latin-1")):
        at = last + 1 - len(magic)
        if at < free:
            continue
        what, size = confirm(view, at, magic)
        if not size:
            continue
        if at == 0:
            kind = what
            if size == len(value):
                continue
        carved.append((what, at, size))
        free = at + size
    return kind, carved


def to_wave(payload: bytes, rate: int = 8000) -> bytes:
    """8-bit mono PCM; the payload's length is even, so no chunk is padded."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def from_wave(stored: bytes) -> bytes:
    place = 12
    while stored[place : place + 4] != b"data":
        place += 8 + (n := struct.unpack_from("<I", stored, place + 4)[0]) + n % 2
    return stored[place + 8 : place + 8 + struct.unpack_from("<I", stored, place + 4)[0]]


def sniff_column(frame: DataFrame, value: str, declared: str, keys: list[str]) -> DataFrame:
    """``keys`` and ``media_type, declared_type, corrected, carved`` for a binary column; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                found = [sniff(v.as_py() or b"") for v in part.column(len(keys))]
                said = part.column(len(keys) + 1).to_pylist()
                kinds = [k for k, _ in found]
                carved = [[dict(zip(("media_type", "start", "length"), c, strict=True)) for c in cs] for _, cs in found]
                wrong = [k != UNKNOWN and k != s for k, s in zip(kinds, said, strict=True)]
                columns = [*part.columns[: len(keys)], pa.array(kinds), pa.array(said, pa.string()), pa.array(wrong), pa.array(carved, _CARVED)]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "media_type", "declared_type", "corrected", "carved"])

    if taken := set(keys) & {"media_type", "declared_type", "corrected", "carved"}:
        raise ValueError(f"columns {sorted(taken)} are names of the result's own")
    picked = frame.select(*keys, frame[value].cast("binary").alias("_value"), frame[declared].cast("string").alias("_declared"))
    own = ", ".join(f"`{k}` {frame.schema[k].dataType.simpleString()}" for k in keys)
    return picked.mapInArrow(run, f"{own}, media_type string, declared_type string, corrected boolean, carved array<struct<media_type:string,start:bigint,length:bigint>>")


_CARVED = pa.list_(pa.struct([("media_type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
