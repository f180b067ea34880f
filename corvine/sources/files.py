"""Sources and sinks over files: folders of PDFs, JSON-lines logs, golden sets, layouts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import arxiv_id, doi, safe_dirname
from .identifiers import is_meaningful, paper_id

GOLDEN = {
    "qa": "version string, test_cases array<struct<id:string,query:string,expected_chunk_ids:array<string>,expected_sources:array<string>,reference_answer:string,expected_abstain:boolean,tags:array<string>>>",
    "retrieval.v1": "schema_version string, corpus struct<selection:string>, test_cases array<struct<id:string,query:string,expected_chunk_ids:array<string>,expected_paper_ids:array<string>,reference_answer:string,search_scope:struct<paper_ids:array<string>>,tags:array<string>,notes:string>>",
    "ragas-eval.v1": "schema_version string, corpus struct<selection:string>, test_cases array<struct<id:string,query:string,paper_ids:array<string>,reference_answer:string,reference_chunk_ids:array<string>,expected_abstain:boolean,tags:array<string>>>",
}


def scan_pdfs(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """``path, title, paper_id, content`` of the PDFs of a folder (not below it), by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    title = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.pdf$", "")
    none = F.lit(None).cast("string")
    rows = files.select("path", title.alias("title"), paper_id(none, none, F.sha1("content")).alias("paper_id"), "content").orderBy("path")
    return rows.limit(limit) if limit else rows


def from_urls(urls: DataFrame, fetch: Callable[[str], bytes] | None = None) -> DataFrame:
    """``url, ok, paper_id, directory, content`` for direct links; only paths that end in ``.pdf`` are fetched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fetch(u) if fetch and ok else None for u, ok in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], ["url", "ok", "content"])

    ok = F.coalesce(F.lower(F.parse_url("url", F.lit("PATH"))).endswith(".pdf"), F.lit(False))
    rows = urls.select("url", ok.alias("ok")).mapInArrow(run, "url string, ok boolean, content binary")
    own = paper_id(arxiv_id(F.col("url")), doi(F.col("url")), F.sha1(F.coalesce("content", F.col("url").cast("binary"))))
    return rows.select("url", "ok", own.alias("paper_id"), safe_dirname(own).alias("directory"), "content")


def parse_pages(files: DataFrame, primary: Callable[[bytes], str], fallback: Callable[[bytes], str]) -> DataFrame:
    """``paper_id, markdown, status``: succeeded, degraded (the fallback's) or failed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column(1).to_pylist():
                text, status = None, "failed"
                for parser, name in ((primary, "succeeded"), (fallback, "degraded")):
                    try:
                        text = parser(raw)
                    except Exception:  # noqa: BLE001  a parser's failure is a status, not the job's
                        continue
                    if text and text.strip():
                        status = name
                        break
                out.append((text, status))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in out], pa.string()), pa.array([s for _, s in out])], ["paper_id", "markdown", "status"])

    parsed = files.select("paper_id", "content").mapInArrow(run, "paper_id string, markdown string, status string")
    empty = ~F.coalesce(is_meaningful(F.col("markdown")), F.lit(False))
    return parsed.withColumn("status", F.when(empty, "failed").otherwise(F.col("status")))


def read_log(spark: SparkSession, path: str, schema: str, key: str = "run_id") -> DataFrame:
    """JSON lines, the newest first; malformed lines and lines without a key are skipped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col(key).isNotNull()).orderBy(F.desc("created_at"))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_golden(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The cases of a golden set; a wrong schema version, no case or an empty query fails the read."""
    whole = spark.read.schema(GOLDEN[kind]).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    version = F.col("version" if kind == "qa" else "schema_version")
    right = version.isNotNull() if kind == "qa" else version == kind
    checked = whole.withColumn("fits", F.assert_true(right & (F.size("test_cases") > 0), F.lit(f"not a {kind} set")))
    cases = checked.where("fits is null").select(F.explode("test_cases").alias("c")).select("c.*")
    bad = F.assert_true((F.coalesce(F.trim("query"), F.lit("")) != "") & F.col("id").isNotNull(), F.lit("a case without id or query"))
    return cases.withColumn("fits", bad).where("fits is null").drop("fits")


def layout_assets(layout: Column) -> Column:
    """Image and table blocks of a layout as an array of ``name, kind, page``."""
    blocks = F.from_json(layout, "array<struct<type:string,img_path:string,page_idx:int>>")
    own = F.filter(blocks, lambda b: b["type"].isin("image", "table") & b["img_path"].isNotNull())
    return F.transform(own, lambda b: F.struct(F.element_at(F.split(b["img_path"], "/"), -1).alias("name"), b["type"].alias("kind"), b["page_idx"].alias("page")))
