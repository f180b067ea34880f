"""Model steps as hooks with deterministic defaults: embedding, reranking, language models, judges."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import overlap

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(width: int = 256) -> Encoder:
    """Signed hashed bags of words, unit length; the default where no model is given."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width), np.float32)
        for i, text in enumerate(texts):
            for word in re.findall(r"[a-z0-9_]+|[一-鿿]", (text or "").lower()):
                h = zlib.crc32(word.encode())
                out[i, h % width] += 1 if h & 0x80000000 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def embed(frame: DataFrame, key: str, text: str, encoder: Callable[[], Encoder] = hashing_encoder, batch: int = 32) -> DataFrame:
    """``key, vector``; the encoder is made once a task and called with ``batch`` texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for rows in batches:
            for begin in range(0, rows.num_rows, batch):
                part = rows.slice(begin, batch)
                vectors = encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(vectors), pa.list_(pa.float32()))], [key, "vector"])

    kind = frame.schema[key].dataType.simpleString()
    return frame.select(key, frame[text].cast("string")).mapInArrow(run, f"`{key}` {kind}, vector array<float>")


def rerank(rows: DataFrame, score: Callable[[Column, Column], Column] = overlap) -> DataFrame:
    """Adds ``score_rerank`` of ``query`` and ``text``; lexical overlap where no model is given."""
    return rows.withColumn("score_rerank", score(F.col("query"), F.col("text")).cast("double"))


def reply_object(reply: Column, schema: str) -> Column:
    """The JSON object in a model's reply, from its first to its last brace."""
    return F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), schema)


def reflection(reply: Column) -> Column:
    """``sufficiency, score, follow_up`` of a reply: sufficient and 0.5 where it says nothing usable."""
    got = reply_object(reply, "sufficiency string, score string, follow_up string")
    named = F.lower(F.trim(got["sufficiency"]))
    score = F.coalesce(got["score"].try_cast("double"), F.lit(0.5))
    return F.struct(F.when(named.isin("sufficient", "partial", "insufficient"), named).otherwise("sufficient").alias("sufficiency"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("score"), F.coalesce(got["follow_up"], F.lit("")).alias("follow_up"))


def concepts(reply: Column, allowed: Column, most: int = 5) -> Column:
    """Concepts in a reply: known categories, evidence among ``allowed``, confidence clipped, ``most`` at most."""
    got = reply_object(reply, "concepts array<struct<name:string,category:string,confidence:double,evidence:array<string>>>")["concepts"]
    fit = F.filter(got, lambda c: (F.trim(c["name"]) != "") & c["category"].isin("concept", "method", "task", "dataset", "metric"))
    made = F.transform(fit, lambda c: F.struct(F.trim(c["name"]).alias("name"), c["category"].alias("category"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c["confidence"], F.lit(0.5)))).alias("confidence"), F.array_intersect(F.coalesce(c["evidence"], F.array().cast("array<string>")), allowed).alias("evidence")))
    return F.slice(F.coalesce(made, F.array().cast("array<struct<name:string,category:string,confidence:double,evidence:array<string>>>")), 1, most)


def verdict(reply: Column, candidates: Column) -> Column:
    """A judge's ``same``, ``different`` or ``unsure``; same only for a candidate."""
    got = reply_object(reply, "decision string, entry_id string")
    return F.when((got["decision"] == "same") & F.array_contains(candidates, got["entry_id"]), "same").when(got["decision"] == "different", "different").otherwise("unsure")
