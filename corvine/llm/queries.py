"""The ten operators as queries over the driver's tables, with their production parameters."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, license_scan, lm_score, media, merkle, mixing, ngram_join, packing, quality_rules, token_counts, toxicity, url_filter, warc
from ._common import by_bytes, table, text_arrays

URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
TOXIC_AT = 0.7


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(doc_id: Column, of: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = lm_score.score_documents(docs, lambda i: F.coalesce(fold(i, 7) != 2, F.lit(True)))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_documents(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), 4096)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.size("mix_places")).alias("taken"), F.transform("mix_places", lambda p: p["shard"]).alias("shards"),
    )


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text is stored as a WAV file of 8-bit samples under a wrong declared type, whose correction tells how to read it back."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "text"):
            data, offsets = text_arrays(part.column(1))
            raw = data.tobytes()
            stored = [media.to_wave(raw[a:b].ljust(max(64, (b - a + 63) // 64 * 64), b"\0")) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(stored, pa.binary()), pa.array(["image/png"] * len(stored))], ["doc_id", "n_bytes", "stored", "declared"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stored, used, found, carved in zip(*batch.columns[2:], strict=True):
                value = stored.as_py()
                back = media.from_wave(value) if used.as_py() == "audio/wav" else b""
                feature = ";".join([found.as_py(), *(f"{c['media_type']}@{c['start']}+{c['length']}" for c in carved.as_py())])
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(value), hashlib.sha256(value).hexdigest(), feature))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stored = docs.mapInArrow(store, "doc_id long, n_bytes long, stored binary, declared string")
    sniffed = media.sniff_column(stored, "stored", "declared", ["doc_id", "n_bytes", "stored"])
    used = F.when(F.col("corrected"), F.col("media_type")).otherwise(F.col("declared_type")).alias("used")
    return sniffed.select("doc_id", "n_bytes", "stored", used, "media_type", "carved").mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths of their own: a source is a tree of directories of 50 ids in directories of 1000."""
    docs = table(spark, sf_dir, "documents")
    part = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    docs = docs.select("doc_id", F.concat_ws("/", "source", part(1000), part(50), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")
    return license_scan.scan(docs, "path")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_classes(table(spark, sf_dir, "documents"), 0.75, 5)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda i: fold(i, 3) != 1)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 1)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 3 divides the id's CRC, the text is lower-cased behind the manifest's back."""
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = lambda d: F.when(fold(d["doc_id"], 3) == 0, merkle.leaf([*(d[f] for f in fields[:-1]), lowered]))
    return merkle.manifest(docs, fields, "lang", "doc_id", tampered).prove().withColumnRenamed("ord", "doc_id")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages as archives into the shared folder and reads them back; a record that fails its checks fails the query."""
    read = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"), warc.new_folder(spark)))
    page = lambda c: F.split_part(c, F.lit(":"), F.lit(3)).try_cast("long")
    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(" ", "archive", "start", "error")).cast("string")).otherwise(F.col("record_type"))
    return read.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", sound.alias("record_type"), page(F.col("refers_to")).alias("refers_to"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_lm_score, op2_url_filter, op3_quality_rules, op4_token_counts, op5_mixing, op6_media, op7_license_scan, op8_ngram_join, op9_toxicity, op10_packing, op11_merkle, op12_token_alignment, op13_warc)}

OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS gram FROM t, LATERAL (SELECT unnest(range(1, greatest(len(w) - 1, 1))) AS i) WHERE len(w) >= 3),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
cover AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
s AS (SELECT t.r, doc_id, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(cover.n, 0) AS n_repeat_words FROM t LEFT JOIN cover ON t.r = cover.r),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM s),
f AS (SELECT *, (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines OR NOT word_chars / greatest(n_words, 1) BETWEEN 3 AND 12) AS bad FROM b),
h AS (SELECT source, count(*) AS docs, sum(bad::INT)::DOUBLE AS failed FROM f GROUP BY source),
p AS (SELECT avg(failed / docs) AS m, coalesce(var_pop(failed / docs), 0) AS v FROM h),
q AS (SELECT m, CASE WHEN v > 0 THEN greatest(1, m * (1 - m) / v - 1) ELSE 1 END AS k FROM p),
ok AS (SELECT source, (failed + m * k) / (docs + k) <= 0.5 AS host_ok FROM h, q)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, (NOT base_failed AND host_ok) AS kept
FROM f JOIN ok ON f.source IS NOT DISTINCT FROM ok.source
"""


def license_sql() -> str:
    """Plain SQL over all lines, paragraphs and sentences, without the bounds."""
    idf, vectors = license_scan.template_weights()
    rows = lambda values: ", ".join(f"({', '.join(repr(v) for v in r)})" for r in values)
    usual = ", ".join(map(repr, sorted(license_scan.USUAL)))
    weights = rows((i, name, w, v) for i, (name, vector) in enumerate(vectors) for w, v in vector.items())
    return f"""
WITH tw(t, license, word, w) AS (VALUES {weights}), idf(word, v) AS (VALUES {rows((w, v) for w, v in idf.items() if w)}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, concat_ws('/', source, (doc_id // 1000)::VARCHAR, (doc_id // 50)::VARCHAR, doc_id || '.txt') AS path FROM documents),
p AS (SELECT r, unnest(regexp_split_to_array(text, '\\n[ \\t\\r\\n]*\\n')) AS p FROM d),
pieces AS (SELECT r, 'line' AS kind, unnest(string_split(text, chr(10))) AS line FROM d UNION ALL SELECT r, 'paragraph', p FROM p
  UNION ALL SELECT r, 'sentence', unnest(string_split(regexp_replace(p, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(30), 'g'), chr(30))) FROM p),
l AS (SELECT *, row_number() OVER () AS n FROM pieces),
w AS (SELECT r, n, unnest(list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x NOT IN ('', {usual}))) AS word FROM l),
f AS (SELECT r, n, w.word, count(*) * coalesce(any_value(idf.v)::DOUBLE, {idf[""]!r}::DOUBLE) AS v FROM w LEFT JOIN idf ON w.word = idf.word GROUP BY r, n, w.word),
norm AS (SELECT r, n, sqrt(sum(v * v)) AS norm FROM f GROUP BY r, n),
dot AS (SELECT r, n, t, license, sum(v * w::DOUBLE) AS dot FROM f JOIN tw ON f.word = tw.word GROUP BY ALL),
s AS (SELECT r, n, license, round(dot / norm, 9) AS score FROM dot JOIN norm USING (r, n)),
b AS (SELECT * FROM s WHERE score >= {license_scan.THRESHOLD} QUALIFY row_number() OVER (PARTITION BY r, n ORDER BY score DESC, license) = 1),
words AS (SELECT r, n, len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS k FROM l),
total AS (SELECT r, len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS k FROM d),
by_kind AS (SELECT r, kind, sum(words.k) AS evidence, arg_min(license, (-score, license)) AS own, max(score) AS score FROM b JOIN words USING (r, n) JOIN l USING (r, n) GROUP BY r, kind),
e AS (SELECT r, max(evidence) AS evidence, arg_min(own, (-score, own)) AS own, max(score) AS score FROM by_kind GROUP BY r),
o AS (SELECT d.r, doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, own, score, coalesce(evidence >= {license_scan.FILE_SHARE} * greatest(k, 1), false) AS license_file FROM d JOIN total USING (r) LEFT JOIN e USING (r)),
speaks AS (SELECT dir, arg_min(own, (-score, own)) AS license FROM o WHERE license_file GROUP BY dir),
up AS (SELECT o.r, speaks.dir, speaks.license FROM o JOIN speaks ON o.dir = speaks.dir OR starts_with(o.dir, speaks.dir || '/') QUALIFY row_number() OVER (PARTITION BY o.r ORDER BY length(speaks.dir) DESC) = 1)
SELECT doc_id, path, own AS own_license, score, license_file, coalesce(own, up.license) AS license, CASE WHEN own IS NULL THEN up.dir END AS inherited_from FROM o LEFT JOIN up USING (r)
"""


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _FIELD + ")"
OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT *, CASE WHEN lang IS NULL THEN '' ELSE 'x' || lang END AS g,
  list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b:
    list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc FROM documents),
leaf AS (SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, {_LEAF.format("text")} AS h,
  CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_LEAF.format("text")} END AS told FROM d),
node(g, level, i, h, n) AS (SELECT g, 0, i, h, count(*) OVER (PARTITION BY g) FROM leaf
  UNION ALL SELECT g, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 7) // 8) FROM node WHERE n > 1 GROUP BY g, level, i // 8),
sub AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS j FROM node WHERE n = 1),
high(level, i, h, n) AS (SELECT 0, j, h, count(*) OVER () FROM sub
  UNION ALL SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 7) // 8) FROM high WHERE n > 1 GROUP BY level, i // 8),
step AS (SELECT doc_id, level, node.i, node.h, (leaf.i // (8 ** level)::BIGINT) = node.i AS own FROM leaf JOIN node USING (g) WHERE n > 1 AND leaf.i // (8 ** (level + 1))::BIGINT = node.i // 8
  UNION ALL SELECT doc_id, 100 + level, high.i, high.h, (j // (8 ** level)::BIGINT) = high.i FROM leaf JOIN sub USING (g), high WHERE n > 1 AND j // (8 ** (level + 1))::BIGINT = high.i // 8),
run AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS k, coalesce(string_agg(h, '' ORDER BY i) FILTER (NOT own AND i < o), '') AS before, coalesce(string_agg(h, '' ORDER BY i) FILTER (NOT own AND i > o), '') AS after
  FROM (SELECT *, max(i) FILTER (own) OVER (PARTITION BY doc_id, level) AS o FROM step) GROUP BY doc_id, level),
folded(doc_id, k, h) AS (SELECT doc_id, 0, told FROM leaf UNION ALL SELECT doc_id, run.k, sha256(before || folded.h || after) FROM folded JOIN run USING (doc_id) WHERE run.k = folded.k + 1),
last AS (SELECT doc_id, arg_max(h, k) AS folded_root FROM folded GROUP BY doc_id),
proof AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY k)) AS p FROM run GROUP BY doc_id)
SELECT doc_id, leaf.h AS leaf, sub.h AS subroot, top.h AS root, coalesce(p, sha256('')) AS proof_sha256, folded_root, folded_root = top.h AS verified
FROM leaf JOIN sub USING (g) JOIN last USING (doc_id) LEFT JOIN proof USING (doc_id), (SELECT h FROM high WHERE n = 1) AS top
"""

OP13_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to FROM f
"""

ORACLE_SQL: dict[str, str] = {"op3_quality_rules": OP3_SQL, "op7_license_scan": license_sql(), "op11_merkle": OP11_SQL, "op13_warc": OP13_SQL}
