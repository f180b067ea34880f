"""The catalogue of queries: name, plan builder and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import concepts, documents, evaluation, ingest, operations, retrieval, store

MODULES = (retrieval, documents, store, concepts, evaluation, operations, ingest)
flagship = retrieval.flagship


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
