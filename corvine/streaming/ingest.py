"""Streaming ingest: new documents are de-duplicated, chunked, fingerprinted and written by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.chunking import chunk_frame
from ..functions.text import chunk_id
from ..operators.ingest import Ingest


def prepared(docs: DataFrame) -> DataFrame:
    """Chunks of ``doc_id, text, lang`` with stable ids and content digests."""
    made = chunk_frame(docs)
    name = chunk_id(F.col("doc_id").cast("string"), F.lit("0"), F.lit("text"), F.col("ordinal"))
    return made.select("doc_id", "ordinal", name.alias("chunk_id"), F.sha2("text", 256).alias("content_id"), "text")


def ingest(docs: DataFrame, out: str, checkpoint: str, done: Callable[[int, int], None] | None = None) -> StreamingQuery:
    """Runs over what is there now; a batch that is repeated overwrites its own folder, so nothing doubles."""

    def write(batch: DataFrame, number: int) -> None:
        prepared(batch.dropDuplicates(["doc_id"])).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if done:
            done(number, batch.sparkSession.read.parquet(f"{out}/batch={number}").count())

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_papers(fetched: DataFrame, into: Ingest, checkpoint: str, name: str = "papers", force: bool = False) -> StreamingQuery:
    """A stream of fetched papers into a store, batch by batch until it has what is there now.

    A batch is one commit labelled by the stream's name and the batch's number, so a batch that is repeated after a failure is
    either there as a whole, and not done again, or not there at all.
    """

    def write(batch: DataFrame, number: int) -> None:
        into.run(batch, force, f"{name}-{number}")

    return fetched.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
