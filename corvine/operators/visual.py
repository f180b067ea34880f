"""Summaries of figures and tables by a vision model: who is asked, what is known already, and what became of each.

Admission is a column of reasons; requests have keys of all that a summary depends on, so equal ones are asked once and known ones never.
``chunks`` are ``paper_id, chunk_id, seq, modality, asset, text, context_text, metadata`` (JSON); ``assets`` are ``asset, size, digest`` of the
files that are there; ``cache`` is ``key, summary, provider``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What is summarised, the words before captions and surroundings, labels of summaries, characters of a surrounding.
VISUAL = ("figure", "table")
CAPTION = r"(?i)^\s*(?:figure|table|图|表)\s*[:：](.*)$"  # noqa: RUF001
AROUND = r"(?i)^\s*(?:context|上下文)\s*[:：](.*)$"  # noqa: RUF001
LABELS = {"zh": "视觉摘要", "en": "Visual summary"}
CONTEXT_CHARS = 500

Summarizer = Callable[[dict], str]
RESULT = "key string, summary string, provider string, status string, error string"


def caption_of(text: Column) -> Column:
    """What stands behind the first caption word of a text, or on the next line that is not blank, unless that is the surroundings."""
    lines = F.split(text, "\n")
    at = F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(CAPTION), i)), lambda i: i.isNotNull()))
    own = F.trim(F.regexp_extract(F.get(lines, at), CAPTION, 1))
    after = F.filter(F.transform(F.slice(lines, at + 2, F.size(lines)), F.trim), lambda x: x != "")
    following = F.when(F.coalesce(F.get(after, 0).rlike(AROUND), F.lit(True)), "").otherwise(F.get(after, 0))
    return F.when(at.isNull(), "").when(own != "", own).otherwise(following)


def context_of(text: Column) -> Column:
    said = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_extract(x, AROUND, 1))), lambda x: x != "")
    return F.coalesce(F.get(said, 0), F.left(text, F.lit(CONTEXT_CHARS)))


def admitted(chunks: DataFrame, assets: DataFrame, most_images: int, most_bytes: int) -> DataFrame:
    """Visual chunks with the asset's ``size, digest`` and ``reason``, null where a summary is asked for.

    The reasons in their order: no asset, no such file, the paper has ``most_images`` already, the file is too large.  Files that are too
    large do not count for the paper.
    """
    rows = chunks.where(F.col("modality").isin(*VISUAL)).join(assets.select("asset", "size", "digest"), "asset", "left")
    fits = (F.coalesce("size", F.lit(most_bytes + 1)) <= most_bytes).cast("int")
    before = Window.partitionBy("paper_id").orderBy("seq", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(fits).over(before), F.lit(0)))
    reason = (
        F.when(F.coalesce("asset", F.lit("")) == "", "missing asset_path")
        .when(F.col("size").isNull(), F.concat(F.lit("asset not found: "), "asset"))
        .when(F.col("before") >= most_images, f"max_images_per_paper={most_images} reached")
        .when(F.col("size") > most_bytes, f"image exceeds max_image_bytes={most_bytes}")
    )
    return rows.withColumn("reason", reason).drop("before")


def requests(rows: DataFrame, model: str, prompt: str = "v1", lang: Column | None = None) -> DataFrame:
    """Admitted rows with ``caption, context, key``: what the metadata say, else what the text says; the key covers file, place and words."""
    said = lambda name: F.get_json_object("metadata", f"$.{name}")
    pick = lambda name, other: F.when(F.coalesce(said(name), F.lit("")) != "", said(name)).otherwise(other)
    out = rows.where("reason is null").withColumns({"caption": pick("caption", caption_of(F.col("text"))), "context": pick("surrounding_context", context_of(F.col("text")))})
    parts = [F.coalesce(c, F.lit("")) for c in ("digest", "paper_id", "chunk_id", "modality", "caption", "context")]
    parts += [F.lit(model), F.lit("") if lang is None else F.coalesce(lang, F.lit("")), F.lit(prompt)]
    return out.withColumn("key", F.sha2(F.concat_ws("\0", *parts), 256))


def asked(wanted: DataFrame, primary: Summarizer, fallback: Summarizer | None = None) -> DataFrame:
    """``RESULT`` of requests ``key, asset, modality, caption, context``: ok, fallback, or failed with the first one's error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for request in batch.to_pylist():
                summary, status, error = None, "failed", None
                for name, model in (("ok", primary), ("fallback", fallback)):
                    try:
                        summary = (model(request) or "").strip() if model else None
                    except Exception as why:  # noqa: BLE001  a model's failure is a status
                        error = error or f"{type(why).__name__}: {why}"
                    if summary:
                        status = name
                        break
                rows.append({"key": request["key"], "summary": summary or None, "provider": {"ok": "primary", "fallback": "fallback"}.get(status), "status": status, "error": None if summary else error or "empty summary"})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(c.split()[0], pa.string()) for c in RESULT.split(", ")]))

    return wanted.select("key", "asset", "modality", "caption", "context").dropDuplicates(["key"]).mapInArrow(run, RESULT)


def enriched(chunks: DataFrame, assets: DataFrame, cache: DataFrame, primary: Summarizer, fallback: Summarizer | None = None, model: str = "", most_images: int = 20, most_bytes: int = 10_000_000, lang: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All chunks with summaries in ``text, context_text`` and ``visual_status, visual_summary, visual_error``; and new rows for the cache.

    A summary is not added twice; fallbacks and failures are not kept, so they are tried again.
    """
    rows = admitted(chunks, assets, most_images, most_bytes)
    wanted = requests(rows, model, lang=F.lit(lang))
    known = wanted.join(cache.select("key", F.col("summary").alias("old"), F.col("provider").alias("old_provider")), "key", "left")
    fresh = asked(known.where("old is null"), primary, fallback).persist()  # both results come from it
    done = known.join(fresh, "key", "left").select("paper_id", "chunk_id", F.coalesce("old", "summary").alias("visual_summary"), F.when(F.col("old").isNotNull(), "cached").otherwise(F.col("status")).alias("visual_status"), F.when(F.col("old").isNull(), F.col("error")).alias("visual_error"))
    skipped = rows.where("reason is not null").select("paper_id", "chunk_id", F.lit(None).cast("string").alias("visual_summary"), F.lit("skipped").alias("visual_status"), F.col("reason").alias("visual_error"))
    line = F.concat(F.lit(LABELS["zh" if lang == "zh" else "en"] + ": "), "visual_summary")
    out = chunks.join(done.unionByName(skipped), ["paper_id", "chunk_id"], "left")
    with_line = lambda c: F.when(F.col("visual_summary").isNull() | F.contains(F.coalesce(c, F.lit("")), line), F.col(c)).when(F.coalesce(c, F.lit("")) == "", line).otherwise(F.concat(F.col(c), F.lit("\n"), line))
    return out.withColumns({c: with_line(c) for c in ("text", "context_text")}), fresh.where("status = 'ok'").select("key", "summary", "provider")
