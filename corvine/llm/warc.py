"""WARC archives compressed by Zstandard with a dictionary: writer, reader, and revisit records for equal payloads.

An archive begins with a skippable frame (magic ``0x184D2A5D``) that holds the dictionary, itself compressed; then each
record is one frame, so a record can be read alone.  Writers train the dictionary on the archive's own first records
(``SAMPLE_ROWS``, ``SAMPLE_BYTES``; fewer than ``LEAST_ROWS`` make an archive without one, whose first frame is then a record).
The reader follows the block headers of each frame to its end, decodes it under the dictionary, and checks the version line, the required
fields, ``Content-Length`` against the block, the closing blank lines, the HTTP length and both digests.  A record that fails is a row with
``error``; reading goes on at the next frame.  A file cut off within a frame ends with such a row.

Of rows with equal payloads of at least ``least`` bytes the one with the smallest id (ties: the first row) is written as
``response``, the others as ``revisit``: HTTP headers without payload, the payload's digest, and the first one's record id.  The first
one of each group is found by an aggregate over digests and joined back; only digests that occur twice take part, and hot ones are broadcast.

Archives are named by task attempt, and the manifest, a table that Spark commits, names those of the attempts that counted; files
of lost attempts are never read.  Archives are opened through ``pyarrow.fs`` (local or mounted folders, HDFS, S3, GCS) in a folder that all executors share.

Defined results: a null payload is empty; a null id is last among equal payloads and reads back as null; a null URL gives no
target field; line ends and blanks in URLs are percent-encoded; repeated rows each get a record; an empty table gives no archive and no rows;
only the three named columns are read.  Rows must come in the same order when read again, as a scan's do; checkpoint others first.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.fs as fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import scratch_folder, spread_join

#: Fixed values of the formats.
VERSION, CLOSING, REVISIT_PROFILE = b"WARC/1.1", b"\r\n\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

LEVEL, DICTIONARY_BYTES, SAMPLE_ROWS, SAMPLE_BYTES, LEAST_ROWS = 3, 32768, 256, 1 << 20, 16
#: Compressed bytes after which a task begins another archive, and bytes read at a time.
ARCHIVE_BYTES, READ_BYTES = 64 << 20, 1 << 20
DATE = "2000-01-01T00:00:00Z"
READ = "archive string, start long, record_type string, record_id string, target_uri string, payload_bytes long, payload_digest string, refers_to string, error string"


def safe_uri(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(url: str | None, record_id: str, payload: bytes, digest: str, refers_to: str | None, date: str = DATE) -> bytes:
    """One record: a response with its payload, or a revisit of ``refers_to`` without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date),
        *([] if url is None else [("WARC-Target-URI", safe_uri(url))]),
        *([("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{refers_to}>")] if refers_to else []),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields), b"", b""]) + block + CLOSING


def fields_of(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"no field: {line[:40]!r}")
        out[name.strip().decode().lower()] = value.strip().decode()
    return out


def parse(data: bytes) -> tuple[dict, bytes]:
    """The checked fields of a record and its payload; raises ``ValueError`` where something does not agree."""
    head, closing, rest = data.partition(CLOSING)
    version, *lines = head.split(b"\r\n")
    if version not in (VERSION, b"WARC/1.0") or not closing:
        raise ValueError(f"no WARC record: {version[:20]!r}")
    fields = fields_of(lines)
    if absent := [k for k in REQUIRED if k.lower() not in fields]:
        raise ValueError(f"without {absent[0]}")
    size = int(fields["content-length"])
    if len(rest) != size + len(CLOSING) or rest[size:] != CLOSING:
        raise ValueError(f"Content-Length {size} of a block of {len(rest) - len(CLOSING)}")
    block = rest[:size]
    checked = {"block": (fields.get("warc-block-digest"), block)}
    out = {"record_type": fields["warc-type"], "record_id": fields["warc-record-id"].strip("<>"), "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to", "").strip("<>") or None}
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        http, blank, payload = block.partition(CLOSING)
        if not blank or not http.startswith(b"HTTP/"):
            raise ValueError("no HTTP message")
        length = int(fields_of(http.split(b"\r\n")[1:]).get("content-length", len(payload)))
        if out["record_type"] == "revisit":
            if payload:
                raise ValueError("a revisit with a payload")
            if "warc-payload-digest" not in fields or not out["refers_to"]:
                raise ValueError("a revisit without digest or target")
        elif length != len(payload):
            raise ValueError(f"HTTP length {length} of a payload of {len(payload)}")
        out["payload_bytes"] = length
    else:
        out["payload_bytes"] = len(payload)
    told = fields.get("warc-payload-digest")
    if out["record_type"] == "revisit":
        out["payload_digest"] = told.removeprefix("sha256:")
    else:
        checked["payload"] = (told, payload)
        out["payload_digest"] = sha256(payload).hexdigest()
    for name, (digest, data_) in checked.items():
        if digest and digest.startswith("sha256:") and digest[7:] != (out["payload_digest"] if name == "payload" else sha256(data_).hexdigest()):
            raise ValueError(f"{name} digest differs")
    return out, payload


class Archive:
    """Writes one archive; records wait until there are enough to train the dictionary."""

    def __init__(self, path: str) -> None:
        self.path, self.waiting, self.held, self.packer, self.size, self.records = path, [], 0, None, 0, 0
        system, inner = fs.FileSystem.from_uri(path)
        self.out = system.open_output_stream(inner, compression=None)  # else the name's ending would have it compressed once more

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def begin(self) -> None:
        trained = None
        if len(self.waiting) >= LEAST_ROWS:
            try:
                trained = zstandard.train_dictionary(max(1024, min(DICTIONARY_BYTES, self.held // 8)), self.waiting, k=200, d=8)
            except zstandard.ZstdError:  # too little or too uniform to learn from
                trained = None
        if trained:
            stored = zstandard.ZstdCompressor(level=LEVEL).compress(trained.as_bytes())
            self.write(DICTIONARY_MAGIC.to_bytes(4, "little") + len(stored).to_bytes(4, "little") + stored)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True, write_content_size=True)
        for data in self.waiting:
            self.write(self.packer.compress(data))
        self.waiting = []

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.packer:
            self.write(self.packer.compress(data))
            return
        self.waiting.append(data)
        self.held += len(data)
        if len(self.waiting) >= SAMPLE_ROWS or self.held >= SAMPLE_BYTES:
            self.begin()

    def close(self) -> tuple[str, int, int]:
        if not self.packer:
            self.begin()
        self.out.close()
        return self.path, self.records, self.size


class Frames:
    """Walks the frames of a file in bounded reads: (place, magic, whole frame)."""

    def __init__(self, stream) -> None:
        self.stream, self.held, self.at = stream, b"", 0

    def need(self, n: int) -> bool:
        """Holds ``n`` bytes from the current place on, if there are that many."""
        if len(self.held) < n:
            parts, have = [self.held], len(self.held)
            while have < n and (more := self.stream.read(max(READ_BYTES, n - have))):
                parts.append(more)
                have += len(more)
            self.held = b"".join(parts)
        return len(self.held) >= n

    def length(self) -> int:
        """Bytes of the frame that begins here, by its own headers; raises ``ValueError`` at the end of a cut file."""
        if not self.need(8):
            raise ValueError("cut off in a frame header")
        magic = int.from_bytes(self.held[:4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            return 8 + int.from_bytes(self.held[4:8], "little")
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame: {magic:08x}")
        self.need(18)
        at = zstandard.frame_header_size(self.held[:18])
        checksum = zstandard.get_frame_parameters(self.held[:18]).has_checksum
        while True:
            if not self.need(at + 3):
                raise ValueError("cut off in a frame")
            block = int.from_bytes(self.held[at : at + 3], "little")
            at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            if block & 1:
                return at + (4 if checksum else 0)

    def __iter__(self) -> Iterator[tuple[int, int, bytes | str]]:
        while self.need(1):
            try:
                n = self.length()
                if not self.need(n):
                    raise ValueError("cut off in a frame")
            except (ValueError, zstandard.ZstdError) as problem:
                yield self.at, 0, str(problem)
                return
            frame, self.held = self.held[:n], self.held[n:]
            yield self.at, int.from_bytes(frame[:4], "little"), frame
            self.at += n


def read_stream(stream, name: str) -> Iterator[tuple[dict, bytes]]:
    """Each record of an archive as a row of ``READ`` with its payload; those that do not hold together as a row with ``error``."""
    blank = dict.fromkeys(("record_type", "record_id", "target_uri", "payload_bytes", "payload_digest", "refers_to", "error"))
    unpack = zstandard.ZstdDecompressor()
    for start, magic, frame in Frames(stream):
        row = blank | {"archive": name, "start": start}
        if not magic:
            yield row | {"error": frame}, b""
            continue
        try:
            if magic == DICTIONARY_MAGIC and not start:
                stored = frame[8:]
                if stored[:4] == FRAME_MAGIC.to_bytes(4, "little"):
                    stored = zstandard.ZstdDecompressor().decompressobj().decompress(stored)
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stored))
                continue
            if magic != FRAME_MAGIC:
                continue
            whole = unpack.decompressobj()
            data = whole.decompress(frame)
            if not whole.eof:
                raise ValueError("frame without end")
            fields, payload = parse(data)
        except (ValueError, zstandard.ZstdError) as problem:
            yield row | {"error": str(problem)}, b""
            continue
        yield row | fields, payload


def mark_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 100) -> DataFrame:
    """``id, url, payload, row, digest, first``: the payload's SHA-256, and of revisits the id and row of the response."""
    rows = pages.select(pages[page_id].alias("id"), pages[url].cast("string").alias("url"), F.coalesce(pages[payload].cast("string"), F.lit("")).cast("binary").alias("payload"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    seen = rows.where(F.octet_length("payload") >= least).groupBy("digest")
    first = seen.agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = spread_join(rows, first, "digest", "n", "left")
    again = F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))
    return joined.select("id", "url", "payload", "row", "digest", F.when(again, F.struct("first.id", "first.row")).alias("first"))


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 100, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives into ``folder`` and returns the committed manifest: ``archive, records, bytes``."""

    def urn(page, row: int) -> str:
        return f"urn:page:{'' if page is None else page}:{row}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, archive, done = TaskContext.get(), None, []
        for batch in batches:
            for page, target, data, row, digest, first in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if archive is None:
                    archive = Archive(f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done):04d}.warc.zst")
                archive.add(record(target, urn(page, row), data, digest, urn(first["id"], first["row"]) if first else None))
                if archive.size >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("archive", "records", "bytes"), map(list, zip(*done, strict=True)), strict=True)))

    system, inner = fs.FileSystem.from_uri(folder)
    system.create_dir(inner, recursive=True)
    marked = mark_revisits(pages, page_id, url, payload, least)
    marked.mapInArrow(write, "archive string, records long, bytes long").write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


def read_archives(archives: DataFrame, payloads: bool = False, most_parts: int = 10_000) -> DataFrame:
    """The records of the archives named in ``archive``, a task per archive up to ``most_parts``; with ``payloads``, their bytes too."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in READ.split(", ")]
        types = [pa.int64() if f.endswith("long") else pa.string() for f in READ.split(", ")]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, inner = fs.FileSystem.from_uri(name)
                with system.open_input_stream(inner, compression=None) as stream:
                    rows, held = [], 0
                    for row, data in read_stream(stream, name):
                        rows.append((*(row[n] for n in names), data) if payloads else tuple(row[n] for n in names))
                        held += len(data) * payloads
                        if len(rows) >= 4096 or held >= 8 << 20:
                            yield batch_of(rows, names, types)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows, names, types)

    def batch_of(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
        kinds = [*types, pa.binary()] if payloads else types
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [*names, "payload"] if payloads else names)

    n = min(max(1, archives.count()), most_parts)
    return archives.select("archive").repartition(n).mapInArrow(read, READ + (", payload binary" if payloads else ""))


def new_folder(spark: SparkSession) -> str:
    return f"{scratch_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
