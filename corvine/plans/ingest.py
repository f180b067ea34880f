"""Queries of the ingest orchestrator, with the SQL of what must become of each paper."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import Ingest
from ..operators.postings import Index
from ..operators.versions import Versions
from ..session import shared_folder
from ..tables import load
from .registry import registry

QUERIES, SQL, query = registry()


def _parser(raw: bytes) -> str:
    """Bytes that begin with a capital vowel are a file that cannot be parsed."""
    if raw[:1] in (b"A", b"E", b"I", b"O", b"U"):
        raise ValueError("broken file")
    return raw.decode()


def _fetched(spark: SparkSession, d: str) -> DataFrame:
    """Documents as papers in the order of ids: some share DOI, arXiv id or title; every third comes as bytes."""
    docs, n = load(spark, d, "documents"), F.col("doc_id")
    name = lambda prefix, of: F.concat(F.lit(prefix), F.floor(n / of).cast("string"))
    return docs.select(
        n.cast("string").alias("paper_id"), n.alias("seq"), F.when(n % 10 < 2, name("10.1/", 20)).alias("doi"), F.when(n % 15 == 2, name("x", 30)).alias("arxiv_id"),
        F.when(n % 25 == 5, name("Same ", 50)).otherwise(F.concat(F.lit("Paper "), n.cast("string"))).alias("title"),
        F.when(n % 3 != 0, F.col("text")).alias("markdown"), F.when(n % 3 == 0, F.encode("text", "UTF-8")).alias("content"),
    )


@query(r"""WITH p AS (SELECT doc_id AS n, CASE WHEN doc_id % 10 < 2 THEN doc_id // 20 END AS doi, CASE WHEN doc_id % 15 = 2 THEN doc_id // 30 END AS arxiv, CASE WHEN doc_id % 25 = 5 THEN doc_id // 50 END AS same,
  (doc_id % 3 = 0 AND (left(text, 1) IN ('A', 'E', 'I', 'O', 'U') OR trim(regexp_replace(text, '\s+', '', 'g')) = '')) OR trim(regexp_replace(text, '\s+', '', 'g')) = '' AS broken, doc_id % 3 <> 0 AS plain FROM documents),
l AS (SELECT *, CASE WHEN arxiv IS NOT NULL THEN min(n) OVER (PARTITION BY arxiv) END AS first_arxiv, CASE WHEN same IS NOT NULL THEN min(n) OVER (PARTITION BY same) END AS first_same FROM p),
m AS (SELECT *, CASE WHEN doi IS NOT NULL THEN min(n) FILTER (coalesce(first_arxiv, n) = n AND coalesce(first_same, n) = n) OVER (PARTITION BY doi) END AS first_doi FROM l),
r AS (SELECT 1 AS run, *, CASE WHEN first_doi < n THEN first_doi WHEN first_arxiv < n THEN first_arxiv WHEN first_same < n THEN first_same END AS into_ FROM m
  UNION ALL SELECT 2, *, CASE WHEN first_doi <> n THEN first_doi WHEN first_arxiv < n THEN first_arxiv WHEN first_same < n THEN first_same END FROM m)
SELECT run::INT AS run, n::VARCHAR AS paper_id, CASE WHEN into_ IS NOT NULL THEN 'skipped' WHEN broken THEN 'failed' WHEN run = 2 THEN 'skipped' ELSE 'done' END AS status,
  CASE WHEN into_ IS NOT NULL THEN 'dedup' WHEN broken THEN CASE WHEN plain THEN 'no_chunks' END WHEN run = 2 THEN 'done' END AS reason, into_::VARCHAR AS merged_into FROM r""")
def ingest_reports(spark: SparkSession, d: str) -> DataFrame:
    """The same batch twice: the second time nothing is new but what failed."""
    folder = shared_folder(spark, "store")
    into = Ingest(Versions(spark, f"{folder}/store"), Index(spark, f"{folder}/index"), primary=_parser, lenient=False)
    batch = _fetched(spark, d)
    runs = [into.run(batch).withColumn("run", F.lit(n)) for n in (1, 2)]
    return runs[0].unionByName(runs[1]).select("run", "paper_id", "status", "reason", "merged_into")
