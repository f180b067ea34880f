"""Manifest, alignment and archives against brute force, in other groupings, and on odd inputs."""

from __future__ import annotations

import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from corvine.llm import align, merkle, queries, warc
from corvine.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- manifest ---------------------------------------------------------------------------------------------------------------------


def leaf(values) -> str:
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def brute_manifest(rows: list[tuple]) -> list[tuple]:
    """Rows of (id, group, text); texts are lower-cased where 3 divides the id's CRC."""
    told = {}
    groups = defaultdict(list)
    for id_, group, text in rows:
        other = text.translate(LOWER) if text is not None and id_ is not None and zlib.crc32(str(id_).encode()) % 3 == 0 else text
        mine = leaf((id_, group, text))
        told[mine] = leaf((id_, group, other))
        groups[group].append((id_ is not None, id_, mine))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([m for *_, m in sorted(groups[g], key=lambda x: (x[0], x[1] or 0, x[2]))]) for g in order}
    top = levels([trees[g][-1][0] for g in order]) if order else [[]]
    out = []
    for j, g in enumerate(order):
        ids = [i for _, i, _ in sorted(groups[g], key=lambda x: (x[0], x[1] or 0, x[2]))]
        for i, mine in enumerate(trees[g][0]):
            node, proof = told[mine], ""
            for tree, at in ((trees[g], i), (top, j)):
                for level in tree[:-1]:
                    run = level[at // 8 * 8 : at // 8 * 8 + 8]
                    proof += "".join(run[: at % 8] + run[at % 8 + 1 :])
                    run[at % 8] = node
                    node, at = H("".join(run)), at // 8
            out.append((ids[i], mine, trees[g][-1][0], top[-1][0], H(proof), node, node == top[-1][0]))
    return sorted(out, key=str)


def manifest_of(frame, **more) -> list[tuple]:
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    claim = lambda d: F.when(F.pmod(F.crc32(d["id"].cast("string").cast("binary")), F.lit(3)) == 0, merkle.leaf([d["id"], d["grp"], low]))
    return sorted(map(tuple, merkle.manifest(frame, ["id", "grp", "text"], "grp", "id", claim, **more).prove().collect()), key=str)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 8}, {"a": 9, "b": 1}, {None: 65, "é": 513, "b": 7, "": 2, "a": 64}, {str(i): 1 + i % 3 for i in range(70)}])
@pytest.mark.parametrize("parts", [1, 7])
def test_manifest_agrees_with_brute_force(spark, sizes, parts):
    rows = [(i, g, f"Text {i} {g}" if i % 11 else None) for g, n in sizes.items() for i in range(100, 100 + n)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "id long, grp string, text string").repartition(3)
    assert manifest_of(frame, part_leaves=max(1, len(rows) // parts)) == brute_manifest(rows)


def test_manifest_of_odd_rows(spark):
    """Null ids, groups and texts, equal rows, empty and very long texts, extra columns with clashing names."""
    rows = [(None, None, None), (None, "a", ""), (1, "a", "X" * 300_000), (1, "a", "X" * 300_000), (1, "a", "Y"), (2, None, "é" * 9), (3, "-", "-"), (4, "1:x", "A\nB")]
    frame = spark.createDataFrame(rows, "id long, grp string, text string").withColumns({"part": F.lit(1), "ord": F.lit("x"), "leaf": F.lit(2), "nth": F.lit(3), "claim": F.lit(0)})
    assert manifest_of(frame) == brute_manifest(rows)
    none = merkle.manifest(frame.limit(0), ["id", "grp", "text"], "grp", "id")
    assert none.root is None and none.prove().count() == 0


def test_forests_merge_in_any_order():
    leaves = [H(str(i)).encode() for i in range(700)]
    root = levels([x.decode() for x in leaves])[-1][0]
    for seed in range(5):
        rng = random.Random(seed)
        cuts = [0, *sorted(rng.sample(range(1, 700), 30)), 700]
        parts = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            forest = merkle.Forest(leaves={merkle.TOP: 1, 0: 700})
            forest.stretch(0, a, b"".join(leaves[a:b]))
            assert len(forest.nodes) <= 14 * 4
            parts.append(forest)
        rng.shuffle(parts)
        while len(parts) > 1:
            parts.append(parts.pop(0).merged(parts.pop(rng.randrange(len(parts)))))
        assert parts[0].roots[merkle.TOP].decode() == root and not parts[0].nodes


def test_paths_of_siblings_give_the_root(spark):
    frame = spark.range(100).select(F.col("id"), (F.col("id") % 3).cast("string").alias("grp"))
    made = merkle.manifest(frame, ["id", "grp"], "grp", "id")
    for row in made.prove(paths=True).collect():
        node = row["leaf"]
        for run in row["path"]:
            node = H("".join(x or node for x in run))
        assert node == made.root and row["verified"]
        assert row["proof_sha256"] == H("".join(x for run in row["path"] for x in run))


# --- alignment --------------------------------------------------------------------------------------------------------------------


def brute_alignment(rows: list[tuple]) -> list[tuple]:
    """By the libraries on whole texts and a walk over both sides' ends."""
    import sentencepiece
    import tokenizers

    one, two, letters = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), align.byte_letters()
    one.encode_special_tokens = True
    docs, counts = [], Counter()
    for id_, text in rows:
        full = (" " + (text or "")).encode()
        a = one.encode(full.decode(), add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in one.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        groups = []
        if text and b"".join(bytes_a) == full == b"".join(bytes_b):
            ends = [{sum(map(len, side[: k + 1])) for k in range(len(side))} if len(side) < 400 else set(_ends(side)) for side in (bytes_a, bytes_b)]
            common = sorted(ends[0] & ends[1])
            at = [0, 0]
            pos = [0, 0]
            for cut in common:
                group = ([], [])
                for k, (ids, side) in enumerate(((a, bytes_a), (b, bytes_b))):
                    while pos[k] < cut:
                        group[k].append(ids[at[k]])
                        pos[k] += len(side[at[k]])
                        at[k] += 1
                groups.append(group)
            counts.update({(x, y) for g, h in groups for x in g for y in h})
            docs.append((id_, len(a), len(b), groups))
        else:
            docs.append((id_, 0, 0, []))
    best: dict[int, int] = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for id_, n_a, n_b, groups in docs:
        links = [(x, y) for g, h in groups for x in g for y in h]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((id_, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), H(text) if groups else ""))
    return sorted(out, key=str)


def _ends(side: list[bytes]):
    at = 0
    for piece in side:
        at += len(piece)
        yield at


TEXTS = [
    (1, None), (2, ""), (3, " "), (4, "  a  b "), (5, "a▁b"), (6, "x\n y  z   w 's <|endoftext|> </s> <0x0A>"), (7, "é è  ü\t\tü 中文字 標點 ，。 "), (None, "a b"), (8, "a b"), (8, "a b"),
    (9, "aé" * 1500), (10, "word " * 20_000), (11, "\x00 \x1f \x85   q"), (12, "中" * 3000), (13, "🎉👍🏽 " * 50), (14, " " * 3000), (15, "\n\n\n \n a\r\n"), (16, "́́ ́ a"), (17, "q" * 20_000),
    (18, "  　 x    y"), (19, "tab\t end  \t x"), (20, "I'll  don't 123 4567"),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "doc_id int, text string").withColumns({"row": F.lit(1), "at": F.lit(2), "side": F.lit("x"), "ids": F.lit(0), "pairs": F.lit(0), "n_a": F.lit(9)}).repartition(3)


def aligned(frame, **more) -> list[tuple]:
    return sorted(map(tuple, align.align(frame, A, B, **more).collect()), key=str)


@pytest.mark.parametrize("more", [{}, {"most_pairs": 0}, {"block_tokens": 7, "step_events": 20}])
def test_alignment_agrees_with_brute_force(texts, more):
    assert aligned(texts, **more) == brute_alignment(TEXTS)


def test_alignment_of_no_rows(texts):
    assert aligned(texts.limit(0)) == [] and aligned(texts.limit(0), most_pairs=0) == []


@pytest.mark.parametrize("step", [5, 1 << 18])
def test_groups_cover_the_text(texts, step):
    found = defaultdict(list)
    for r in align.token_groups(texts, A, B, block_tokens=11, step_events=step).collect():
        found[r["row"], r["doc_id"]].append(r)
    sizes = Counter()
    for (_, id_), rows in found.items():
        rows.sort(key=lambda r: r["start"])
        assert rows[0]["start"] == 0 and all(x["end"] == y["start"] for x, y in zip(rows, rows[1:], strict=False))
        sizes[id_] += rows[-1]["end"]
    assert sizes[10] == 1 + len(TEXTS[11][1]) and sizes[17] == 20_001


def test_segments_are_encoded_as_in_their_texts():
    """Cutting at blanks changes no token: random texts of blanks, line ends, marks, letters and digits."""
    import numpy as np
    import pyarrow as pa

    from corvine.llm._common import text_arrays

    rng = random.Random(5)
    letters = ["a", "B", "é", "中", "1", " ", " ", "  ", "\n", "\t", " ", "'s", "'", ".", "!", " ", "\x1c", "ß", "x"]
    rows = [" " + "".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    data, offsets = text_arrays(pa.array(rows))
    for side in align.encoders(A, B):
        ids, tokens, good = side.ids(data, offsets)
        whole = [side.side.encode([r.encode()])[0] for r in rows]
        assert np.split(ids, np.cumsum(tokens)[:-1])[0].tolist() == whole[0]
        assert [x.tolist() for x in np.split(ids, np.cumsum(tokens)[:-1])] == whole and good.all()


# --- archives ---------------------------------------------------------------------------------------------------------------------

LONG = "<p>" + "long payload " * 100_000
PAGES = [
    (1, "http://a/", "x" * 100), (2, None, "x" * 100), (3, "http://b/\r\nX: y é", "x" * 99), (4, "http://c/", "x" * 99), (5, "http://d/", None), (6, "http://e/", ""), (None, "http://f/", "x" * 100),
    (7, "http://g/", LONG), (7, "http://g/", LONG), (8, "http://h/", LONG), (None, None, "y" * 200), (None, None, "y" * 200), (9, "http://i/", "é" * 50 + "\r\n\r\nWARC/1.1"), (10, "http://j/", "é" * 50 + "\r\n\r\nWARC/1.1"),
]


def brute_archive(rows: list[tuple]) -> list[tuple]:
    first: dict[bytes, int] = {}
    out = []
    for n, (page, _, html) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        data = (html or "").encode()
        again = len(data) >= 100 and data in first
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None))
        first.setdefault(data, page)
    return sorted(out, key=str)


def archived(spark, frame, **more) -> list[tuple]:
    folder = warc.new_folder(spark)
    read = warc.read_archives(warc.write_archives(frame, folder, **more), payloads=True).collect()
    assert not [r for r in read if r["error"]]
    number = lambda name: int(name.split(":")[2]) if name and name.split(":")[2] else None
    for r in read:
        assert hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] if r["record_type"] == "response" else not r["payload"]
    return sorted(((number(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"])) for r in read), key=str)


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_archives_come_back(spark, size):
    frame = spark.createDataFrame(PAGES, "page_id int, url string, html string").withColumns({"row": F.lit(1), "digest": F.lit("x"), "first": F.lit(0), "payload": F.lit(2), "id": F.lit(5)})
    assert archived(spark, frame.coalesce(1), archive_bytes=size) == brute_archive(PAGES)
    assert archived(spark, frame.limit(0)) == []


def test_many_pages_with_a_dictionary(spark):
    rows = [(i, f"http://x/{i}", f"<html><body>page {i % 700} " + "and the same words again " * (i % 13) + "</body></html>") for i in range(2000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = warc.new_folder(spark)
    made = warc.write_archives(frame, folder)
    read = warc.read_archives(made).collect()
    assert sorted(int(r["record_id"].split(":")[2]) for r in read) == list(range(2000)) and made.agg(F.sum("records")).first()[0] == 2000
    want = {r[0]: r for r in brute_archive(rows)}
    assert all((r["record_type"], r["payload_digest"]) == want[int(r["record_id"].split(":")[2])][3:1:-1] for r in read)
    with open(made.first()["archive"].removeprefix("file://"), "rb") as file:
        assert file.read(4) == b"\x5d\x2a\x4d\x18"


def archive_bytes(n: int = 40) -> bytes:
    import tempfile

    path = f"{tempfile.mkdtemp()}/x.warc.zst"
    made = warc.Archive(path)
    for i in range(n):
        data = f"payload number {i} with words in common".encode()
        made.add(warc.record(f"http://x/{i}", f"urn:page:{i}:{i}", data, hashlib.sha256(data).hexdigest(), None))
    made.close()
    with open(path, "rb") as file:
        return file.read()


def test_one_bad_frame_spoils_no_other():
    whole = archive_bytes()
    rows = [r for r, _ in warc.read_stream(io.BytesIO(whole), "x")]
    assert len(rows) == 40 and not any(r["error"] for r in rows)
    at = rows[7]["start"] + 20
    broken = whole[:at] + bytes([whole[at] ^ 255]) + whole[at + 1 :]
    rows = [r for r, _ in warc.read_stream(io.BytesIO(broken), "x")]
    assert [r["record_id"] for r in rows if not r["error"]] == [f"urn:page:{i}:{i}" for i in range(40) if i != 7] and sum(bool(r["error"]) for r in rows) == 1
    cut = [r for r, _ in warc.read_stream(io.BytesIO(whole[:-5]), "x")]
    assert len(cut) == 40 and "cut off" in cut[-1]["error"] and not any(r["error"] for r in cut[:-1])
    assert [r for r, _ in warc.read_stream(io.BytesIO(b""), "x")] == []


def test_records_that_do_not_hold_together():
    data = b"some payload"
    good = warc.record("http://x/", "urn:page:1:1", data, hashlib.sha256(data).hexdigest(), None)
    assert warc.parse(good)[1] == data
    for old, new, problem in (
        (b"WARC/1.1", b"WARP/1.1", "no WARC"), (b"WARC-Date", b"WARC-Dote", "without WARC-Date"), (b"some payload", b"same payload", "digest"), (b"Content-Length: 12", b"Content-Length: 11", "length"),
        (b"\r\n\r\n\r\n", b"", "Content-Length"), (b"some payload", b"some payloads", "Content-Length"),
    ):
        bad = good[: -len(b"\r\n\r\n")] if new == b"" else good.replace(old, new)
        with pytest.raises(ValueError, match=problem):
            warc.parse(bad)


def test_reader_takes_a_raw_dictionary_and_frames_without_sizes():
    records = [warc.record(f"http://x/{i}", f"urn:page:{i}:{i}", b"abc" * 50, hashlib.sha256(b"abc" * 50).hexdigest(), None) for i in range(30)]
    trained = zstandard.train_dictionary(4096, records * 10, k=50, d=8)
    raw = trained.as_bytes()
    packer = zstandard.ZstdCompressor(dict_data=trained)

    def frame(data):
        out = packer.compressobj()
        return out.compress(data) + out.flush()

    whole = (0x184D2A5D).to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw + b"".join(map(frame, records))
    rows = [r for r, _ in warc.read_stream(io.BytesIO(whole), "x")]
    assert len(rows) == 30 and not any(r["error"] for r in rows)


# --- queries ----------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_merkle", "op13_warc"])
def test_queries_agree_with_their_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{d}/{table}.parquet')")
    got = queries.QUERIES[name](spark, d)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_alignment_query_agrees_with_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op12_token_alignment"](spark, d).collect()), key=str) == brute_alignment(rows)
