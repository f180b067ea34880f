"""The driver's tables, and how they stand for chunks, papers and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Section names that documents get by id, as they have none of their own.
SECTIONS = ("Abstract", "Introduction", "Related Work", "Method", "Approach", "Experiments", "Results", "Discussion", "Conclusion", "References")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunk_id, paper_id, text, lang, section, modality`` from ``documents``."""
    kind = F.col("doc_id") % 12
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.col("source").alias("paper_id"),
        "text",
        "lang",
        F.get(F.array(*map(F.lit, SECTIONS)), (F.col("doc_id") % 10).cast("int")).alias("section"),
        F.when(kind == 0, "figure").when(kind == 1, "table").when(kind == 2, "formula").otherwise("text").alias("modality"),
    )


CHUNK_SQL = f"""chunk AS (SELECT doc_id AS chunk_id, source AS paper_id, text, lang,
  list_extract({list(SECTIONS)}, (doc_id % 10)::INT + 1) AS section,
  CASE doc_id % 12 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' WHEN 2 THEN 'formula' ELSE 'text' END AS modality FROM documents)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
