"""From raw documents to packed sequences in five stages; each reads what the one before wrote."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm import mixing, ngram_join, packing, quality_rules, toxicity
from corvine.llm._common import BROADCAST_ROWS, kept, scratch_folder, spread_join
from corvine.llm.queries import TOXIC_AT, fold, table, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of input a task of the mix's output is planned for.
TASK_BYTES = 32 << 20


def keyed(docs: DataFrame) -> DataFrame:
    """With ``row_key``, a 64-bit hash of the whole row: ids may be null or repeat, and equal rows are told apart by nothing."""
    return docs.select(*COLUMNS, F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]).alias("row_key"))


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose ``row_key`` is not in ``keys``; up to ``BROADCAST_ROWS`` keys (counted) are sent to the texts, more meet them in a shuffle."""
    keys = kept(keys.select(F.col("row_key").alias("key")).distinct())
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    return docs.join(keys, docs["row_key"] == keys["key"], "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that the toxicity model scores at the threshold or above, whatever their ids; texts are not shuffled.

    A null or empty text stays; without labels nothing is dropped; an empty table stays empty; columns beside ``COLUMNS`` go.
    """
    scored = toxicity.score_texts(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), lambda i: fold(i, 3) != 1, carry=COLUMNS[1:])
    return scored.where(F.col("score") < TOXIC_AT).select(*COLUMNS)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that fail a base rule or whose host is rejected, whatever their ids.

    A null text fails; rows of null source are a host; equal rows share their verdict; an empty table stays empty.
    """
    docs = keyed(docs)
    rejected = quality_rules.judge_documents(docs, "row_key").where(~F.col("kept"))
    return without(docs, rejected.select(F.col("doc_id").alias("row_key"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts: the one with the smallest id; null ids come last, of equal ids the least key stays.

    Of equal rows one stays.  Null and empty texts are linked with nothing; an empty table stays empty.
    """
    docs = keyed(docs)
    found = ngram_join.similar_classes(docs, doc_id="row_key")
    groups = kept(found.select(F.col("doc_id").alias("row_key"), F.coalesce("component_id", "doc_id").alias("group")))
    sizes = groups.groupBy("group").agg(F.count("*").alias("rows")).where("rows > 1")
    several = kept(spread_join(groups, kept(sizes), "group", "rows").distinct())
    # only rows of groups meet their ids, each key once
    some = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several
    ids = docs.select("row_key", "doc_id").join(some, "row_key").groupBy("row_key", "group").agg(F.min("doc_id").alias("doc_id"))
    first = ids.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first"))
    first = kept(first.select(F.col("first.row_key").alias("key")).distinct())
    first = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    chosen = docs.join(first, docs["row_key"] == first["key"], "left_semi").dropDuplicates(["row_key"])
    return without(docs, several).select(*COLUMNS).unionByName(chosen.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, dealt to the mix's shards and shuffled there, in as many tasks as the input's bytes ask for.

    A null source is a source; a null or empty text has no words and is taken as its block is; an empty table stays empty.
    """
    size = docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    size = size if size < 1 << 60 else 0  # not known
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / TASK_BYTES))
    mixed = mixing.mix(docs.select(*COLUMNS))
    placed = mixed.select(*COLUMNS, F.explode("mix_places").alias("place"))
    dealt = placed.repartition(tasks, "place.shard", F.pmod("place.key", F.lit(max(64, tasks))))
    return dealt.sortWithinPartitions("place.shard", "place.key").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a packed sequence; a null text is an end id alone, repeated rows are packed each for themselves."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), 1)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", apply_quality_rules),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The toxicity model, the n-gram components and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages; what a stage wrote is deleted when the next one has written."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    folder = f"{scratch_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            old = spark._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        before = path
    return docs
