"""The concept store's rules: labels, context, patches, sampling, hints; and public projections."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import CJK_INDEX, CJK_WIDE, clip
from .operations import first_in_window
from .store import resolve_redirects

#: Citations of chunks in definitions; words that no phrase needs.
CITED = r"\s*[\[(]\s*chunk:[^\])]*[\])]"
STOP_EN = ("and", "are", "for", "from", "into", "learn", "learns", "learning", "method", "paper", "that", "the", "this", "with")
STOP_ZH = ("本文", "研究", "提出", "一种", "通过", "进行", "基于", "相关", "问题", "以及", "可以", "用于", "任务", "范式")

#: Sections in the order in which their texts are sampled.
SECTION_ORDER = (("abstract", "摘要"), ("introduction", "引言", "绪论", "背景"), ("conclusion", "discussion", "结论", "总结", "讨论"), ("method", "approach", "model", "方法", "模型"))
#: Keys that are never stored.
SENSITIVE = r"(?i)(api[_-]?key|secret|password|prompt|source[_-]?path|asset[_-]?path)"
#: Question words (all in one group must be there) and the variants they add.
TOPICS = (
    ((("recall@k",), ("precision@k",), ("retrieval",)), ("RAG retrieval evaluation metrics recall precision retrieval stage", "retrieval augmented generation evaluation recall@k precision@k")),
    ((("factscore", "fact score"),), ("Self-RAG FactScore biographies factuality metric atomic facts", "FactScore SELF-RAG evaluation factuality biographies", "FactScore factuality precision atomic facts knowledge source")),
    ((("chunk",), ("size", "embedding", "production")), ("RAG survey chunking strategy 100 256 512 embedding chunks", "retrieval augmented generation chunk size embedding granularity", "chunking strategy larger chunks capture more context smaller chunks retrieval precision")),
    ((("latency",), ("rerank", "retrieval", "rag")), ("retrieval latency reranking dense retriever latency cost", "BEIR retrieval latency reranking dense retrieval efficiency", "RAG higher latency retrieval augmentation rerank chunks")),
    ((("rag-sequence",), ("rag-token",)), ("RAG-Sequence uses the same retrieved document for the whole sequence", "RAG-Token can use different retrieved documents for each target token", "RAG-Sequence RAG-Token latent documents per sequence per token model difference")),
    ((("pre-retrieval", "post-retrieval"),), ("Advanced RAG pre-retrieval post-retrieval optimization strategies indexing retrieval generation", "RAG survey pre-retrieval optimization data indexing query optimization", "RAG survey post-retrieval processing reranking context compression optimization")),
)


@F.pandas_udf(StringType())
def label_norm(text: pd.Series) -> pd.Series:
    """Letters and digits only, in compatibility form and case-folded, which no built-in function does; null is empty."""
    return text.map(lambda x: "".join(c for c in unicodedata.normalize("NFKC", x or "").casefold() if c.isalnum()))


def label_language(text: Column) -> Column:
    return F.when(text.rlike(f"[{CJK_WIDE}]"), "zh").when(text.rlike("[A-Za-z]"), "en")


def is_short(text: Column) -> Column:
    """One CJK character, or up to four others; such labels alone never merge concepts."""
    norm = label_norm(text)
    cjk = F.length(F.regexp_replace(norm, f"[^{CJK_WIDE}]", ""))
    return F.when(cjk > 0, cjk <= 1).otherwise(F.length(norm) <= 4)


def alias_kind(text: Column, language: Column, primary: Column) -> Column:
    return F.when((language == "en") & is_short(text), "acronym").when(language != F.coalesce(label_language(primary), F.lit("en")), "translation").otherwise("variant")


def section_bucket(section: Column) -> Column:
    low, out = F.lower(F.coalesce(section, F.lit(""))), F.lit(len(SECTION_ORDER))
    for place, names in reversed(list(enumerate(SECTION_ORDER))):
        out = F.when(low.rlike("|".join(names)), place).otherwise(out)
    return out


def fill_budget(items: Column, budget: int) -> Column:
    """Of ordered ``struct(id, cost)`` those that fit the budget; the first always does, later ones that do not are passed over."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("ids"))

    def take(state: Column, item: Column) -> Column:
        full = (state["used"] >= budget) | ((F.size(state["ids"]) > 0) & (state["used"] + item["cost"] > budget))
        return F.when(full, state).otherwise(F.struct((state["used"] + item["cost"]).alias("used"), F.concat(state["ids"], F.array(item["id"])).alias("ids")))

    return F.aggregate(items, start, take, lambda s: s["ids"])


def strip_citations(text: Column) -> Column:
    """Without citations of chunks in brackets or parentheses and the blanks before them."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), CITED, ""), r"^\s+|\s+$", "")


def clip_definition(text: Column, most: int = 1200) -> Column:
    return clip(strip_citations(text), most)


def context_row(entries: DataFrame) -> DataFrame:
    """What an answer may see of a concept: five aliases, eight papers, eight chunks."""
    aliases = F.slice(F.filter("labels", lambda x: x != F.col("name")), 1, 5)
    return entries.select("entry_id", "name", strip_citations(F.col("definition")).alias("definition"), aliases.alias("aliases"), F.slice("key_papers", 1, 8).alias("key_papers"), F.slice("evidence_chunks", 1, 8).alias("evidence_chunks"), "version")


def definition_phrases(definition: Column, stopwords: Sequence[str] = STOP_EN, zh_stopwords: Sequence[str] = STOP_ZH) -> Column:
    """The first six and the last three words that are no stop words, and the first eight characters of each
    Chinese run without the stop words at its edges."""
    text = F.coalesce(definition, F.lit(""))
    words = F.filter(F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z][A-Za-z0-9-]{2,})"), F.lit(1)), F.lower), lambda w: ~w.isin(*stopwords))
    edge = "|".join(zh_stopwords)
    runs = F.transform(F.regexp_extract_all(text, F.lit(f"([{CJK_INDEX}]{{2,}})"), F.lit(1)), lambda r: F.regexp_replace(r, f"^({edge})+|({edge})+$", ""))
    runs = F.transform(F.filter(runs, lambda r: F.length(r) >= 2), lambda r: F.left(r, F.lit(8)))
    head = F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, 6), " "))
    tail = F.when(F.size(words) >= 3, F.array_join(F.slice(words, -3, 3), " "))
    return F.array_distinct(F.concat(F.array_compact(F.array(head, tail)), runs))


def apply_patches(edges: DataFrame, ops: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges ``entry_id, kind, value`` after operations ``entry_id, op, value``; evidence must be in ``allowed``."""
    kind = F.when(F.col("op") == "add_label", "label").when(F.col("op") == "add_key_paper", "paper").when(F.col("op") == "add_evidence", "evidence").when(F.col("op") == "add_open_problem", "problem")
    new = ops.select("entry_id", kind.alias("kind"), F.trim("value").alias("value")).where("kind is not null and value <> ''")
    evidence = new.where("kind = 'evidence'").join(allowed, "value", "left_semi")
    return edges.unionByName(new.where("kind <> 'evidence'")).unionByName(evidence.select("entry_id", "kind", "value")).distinct()


def upsert_entries(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries ``entry_id, name, version``: known ones get new values and the next version, all touched ones are dirty."""
    n = new.select("entry_id", F.col("name").alias("new_name"), F.lit(True).alias("touched"))
    joined = old.join(n, "entry_id", "full_outer")
    version = F.when(F.col("version").isNull(), 1).when(F.col("touched"), F.col("version") + 1).otherwise(F.col("version"))
    return joined.select("entry_id", F.coalesce("new_name", "name").alias("name"), version.alias("version"), F.coalesce("touched", F.lit(False)).alias("dirty"))


def topical_variants(question: Column, most: int = 5) -> Column:
    low, found = F.lower(question), []
    for groups, variants in TOPICS:
        hit = F.lit(True)
        for words in groups:
            one = F.lit(False)
            for w in words:
                one = one | F.contains(low, F.lit(w))
            hit = hit & one
        found.append(F.when(hit, F.array(*map(F.lit, variants))).otherwise(F.array().cast("array<string>")))
    return F.slice(F.array_distinct(F.concat(*found)), 1, most)


def scrub(values: Column) -> Column:
    """A map without sensitive keys."""
    return F.map_filter(values, lambda k, v: ~k.rlike(SENSITIVE))


@F.pandas_udf(StringType())
def scrub_json(text: pd.Series) -> pd.Series:
    """A JSON text without sensitive keys at any depth, compact; what is no JSON becomes null."""

    def clean(value):
        if isinstance(value, dict):
            return {k: clean(v) for k, v in value.items() if not re.search(SENSITIVE, k)}
        return [clean(v) for v in value] if isinstance(value, list) else value

    def one(value: str | None) -> str | None:
        try:
            return None if value is None else json.dumps(clean(json.loads(value)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return text.map(one)


def mask_message(message: Column, secrets: Sequence[str | None]) -> Column:
    """An error's text in which each secret that is set reads ``***``."""
    for secret in secrets:
        message = F.replace(message, F.lit(secret), F.lit("***")) if secret else message
    return message


def cache_key(question: Column, fingerprint: Column, top_k: Column, rewrite: Column) -> Column:
    parts = F.concat_ws("\n", F.when(fingerprint != "", F.concat(F.lit("wiki_context_fingerprint:"), fingerprint)), F.concat(F.lit("retrieval_top_k:"), top_k.cast("string")), F.when(~rewrite, "query_rewrite:false"))
    return F.when(parts == "", question).otherwise(F.concat(question, F.lit("\n\n"), parts))


def metric_labels(labels: Column) -> Column:
    """``{a="1",b="2"}`` with sorted keys; empty without labels."""
    parts = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    return F.when(F.size(parts) == 0, "").otherwise(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))


def stage_rows(runs: DataFrame) -> DataFrame:
    """Ranked rows of the stages of ``run_id, stages map<string, array<struct<chunk_id, score, text>>>``, texts cut to 500."""
    stages = runs.select("run_id", F.explode("stages").alias("stage", "hits"))
    ranked = stages.select("run_id", "stage", F.posexplode("hits").alias("rank", "hit"))
    return ranked.select("run_id", "stage", "rank", "hit.chunk_id", "hit.score", F.left("hit.text", F.lit(500)).alias("text"))


def best_of_stage(rows: DataFrame) -> DataFrame:
    """Of each chunk of a stage the row with the best score."""
    n = F.row_number().over(Window.partitionBy("run_id", "stage", "chunk_id").orderBy(F.desc("score"), "rank"))
    return rows.withColumn("n", n).where("n = 1").drop("n")


def eligibility(samples: DataFrame, needs_context: bool, needs_reference: bool) -> DataFrame:
    """``query_id, status`` before a judge is asked: not_applicable, error or eligible."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    missing = blank(F.col("response")) | (F.lit(needs_context) & (F.coalesce(F.size("contexts"), F.lit(0)) <= 0)) | (F.lit(needs_reference) & blank(F.col("reference")))
    return samples.select("query_id", F.when(F.col("expected_abstain"), "not_applicable").when(missing, "error").otherwise("eligible").alias("status"))


def merge(entries: DataFrame, edges: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries, edges and the outcome of each merge (``source_id, target_id, final_id, outcome``).

    ``entries`` are ``entry_id, version, merged_into, dirty``, ``edges`` are ``entry_id, kind, value`` (labels by their norms).  The target,
    along redirects, takes up the source's edges that it lacks, gets the next version and is dirty; the source points to it and keeps its own
    edges.  ``outcome`` is merged, cycle (the target leads back to the source), missing, or conflict: an entry is in more than one of these
    merges, which then have to come one after the other.
    """
    target = resolve_redirects(entries).select(F.col("entry_id").alias("target_id"), F.col("target_id").alias("final_id"))
    asked = merges.select("source_id", "target_id").distinct().join(target, "target_id", "left")
    there = entries.select(F.col("entry_id").alias("source_id"), F.lit(True).alias("known"))
    asked = asked.join(there, "source_id", "left")
    ends = asked.select(F.explode(F.array_distinct(F.array("source_id", F.coalesce("final_id", "target_id")))).alias("end")).groupBy("end").agg(F.count("*").alias("n"))
    most = lambda c: F.coalesce(F.col(f"n_{c}"), F.lit(1)) > 1
    for c in ("source_id", "final_id"):
        asked = asked.join(ends.select(F.col("end").alias(c), F.col("n").alias(f"n_{c}")), c, "left")
    outcome = F.when(F.col("known").isNull() | F.col("final_id").isNull(), "missing").when(F.col("final_id") == F.col("source_id"), "cycle").when(most("source_id") | most("final_id"), "conflict").otherwise("merged")
    done = asked.select("source_id", "target_id", "final_id", outcome.alias("outcome"))
    good = done.where("outcome = 'merged'").select("source_id", "final_id")
    moved = edges.join(good, edges["entry_id"] == good["source_id"]).select(F.col("final_id").alias("entry_id"), "kind", "value").distinct()
    more = edges.unionByName(moved.join(edges, ["entry_id", "kind", "value"], "left_anti"))
    out = entries.join(good.withColumnRenamed("source_id", "entry_id"), "entry_id", "left").join(good.select(F.col("final_id").alias("entry_id"), F.lit(True).alias("grows")), "entry_id", "left")
    version = F.when(F.col("grows"), F.col("version") + 1).otherwise(F.col("version"))
    out = out.select("entry_id", version.alias("version"), F.coalesce("final_id", "merged_into").alias("merged_into"), F.coalesce("grows", "dirty").alias("dirty"))
    return out, more, done


def apply_definitions(entries: DataFrame, proposals: DataFrame, hours: int) -> DataFrame:
    """Entries ``entry_id, definition, lock_until`` after ``proposals`` (``entry_id, definition, at, seq``), which come in the order of time.

    A proposal counts if the entry is not locked at its time, and locks it for ``hours``; blank ones count for nothing.
    """
    open_ = proposals.where(F.trim(F.coalesce("definition", F.lit(""))) != "").withColumn("definition", F.trim("definition"))
    open_ = open_.join(entries.select("entry_id", "lock_until"), "entry_id").where(F.col("lock_until").isNull() | (F.col("at") >= F.col("lock_until"))).drop("lock_until")
    taken = first_in_window(open_, ["entry_id"], "at", hours * 3600 - 1e-6, "seq")  # at the very end of a lock the next one counts
    last = taken.groupBy("entry_id").agg(F.max(F.struct("at", "seq", "definition")).alias("last"))
    until = F.timestamp_add("HOUR", F.lit(hours), F.col("last.at"))
    return entries.join(last, "entry_id", "left").select("entry_id", F.coalesce("last.definition", "definition").alias("definition"), F.coalesce(until, "lock_until").alias("lock_until"))
