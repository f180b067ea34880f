"""Table maintenance as joins: upserts, snapshots, diffs, cascades, concept edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, insert_only: Sequence[str] = ()) -> DataFrame:
    """New rows overwrite old ones field by field where they are not null; ``insert_only`` fields keep old values."""
    n = new.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in new.columns if c != key])
    joined = old.withColumn("was", F.lit(True)).join(n, key, "full_outer")
    value = lambda c: F.coalesce(c, f"new_{c}") if c in insert_only else F.coalesce(f"new_{c}", c)
    return joined.select(key, *[value(c).alias(c) for c in old.columns if c != key])


def replace_snapshot(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """For owners in ``new`` exactly its rows, for others the old ones."""
    kept = old.join(new.select(owner).distinct(), owner, "left_anti")
    return kept.select(*old.columns).unionByName(new.select(*old.columns))


def incremental_diff(new: DataFrame, old: DataFrame, key: str = "point_id") -> DataFrame:
    """``key, action``: vector, payload, skip or delete, from fingerprints.

    Both sides have ``content_id, embedding_version, payload_fingerprint``; keys of ``new`` are unique.
    """
    names = ("content_id", "embedding_version", "payload_fingerprint")
    n = new.select(key, *[F.col(c).alias(f"new_{c}") for c in names], F.lit(True).alias("in_new"))
    o = old.select(key, *[F.col(c).alias(f"old_{c}") for c in names], F.lit(True).alias("in_old"))
    missing = F.col("old_content_id").isNull() | F.col("old_embedding_version").isNull() | F.col("old_payload_fingerprint").isNull()
    moved = (F.col("new_content_id") != F.col("old_content_id")) | (F.col("new_embedding_version") != F.col("old_embedding_version"))
    action = (
        F.when(F.col("in_new").isNull(), "delete")
        .when(F.col("in_old").isNull() | missing | moved, "vector")
        .when(F.col("new_payload_fingerprint") != F.col("old_payload_fingerprint"), "payload")
        .otherwise("skip")
    )
    return n.join(o, key, "full_outer").select(key, action.alias("action"))


def apply_diff(new: DataFrame, old: DataFrame, key: str = "point_id") -> DataFrame:
    """The points after the diff, with the ``action`` that made each: new rows where the vector or the payload moved, else old ones.

    A ``vector`` column, where there is one, is the old one unless the action is vector, so new rows need none for other actions.
    """
    acts = incremental_diff(new, old, key).where("action <> 'delete'")
    fresh = acts.join(new, key)
    out = fresh.where("action = 'vector'").select("action", *new.columns)
    kept = acts.where("action <> 'vector'").join(old, key)
    if "vector" in old.columns:
        payload = fresh.where("action = 'payload'").drop("vector").join(old.select(key, "vector"), key)
    else:
        payload = fresh.where("action = 'payload'")
    return out.unionByName(payload.select("action", *new.columns)).unionByName(kept.where("action = 'skip'").select("action", *new.columns))


def payload(frame: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """The allowed columns that the frame has, in their order; nested values as JSON."""
    nested = ("array", "map", "struct")
    kinds = dict(frame.dtypes)
    return frame.select(*[F.to_json(c).alias(c) if kinds[c].startswith(nested) else F.col(c) for c in allowed if c in kinds])


def assert_unique(frame: DataFrame, key: str) -> DataFrame:
    """The frame, failing at run time if a key comes twice."""
    n = F.count("*").over(Window.partitionBy(key))
    wrong = F.raise_error(F.concat(F.lit(f"duplicate {key}: "), F.col(key).cast("string"))).cast("boolean")
    return frame.withColumn("unique_key", F.when(n > 1, wrong).otherwise(True)).where("unique_key").drop("unique_key")


def fingerprint(*values: Column) -> Column:
    """Order-free digest of a group's values: SHA-1 of its sorted lines."""
    return F.sha1(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\t", *values))), "\n"))


def first_match(wanted: DataFrame, known: DataFrame, id_column: str, keys: Sequence[str]) -> DataFrame:
    """``id_column, match_id, matched_by``: the first key in order under which a known row agrees."""
    out = wanted
    found = []
    for place, key in enumerate(keys):
        least = known.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"k{place}")).agg(F.min(id_column).alias(f"m{place}"))
        out = out.join(least, out[key] == least[f"k{place}"], "left").drop(f"k{place}")
        found.append(F.when(F.col(f"m{place}").isNotNull(), F.struct(F.col(f"m{place}").alias("id"), F.lit(key).alias("by"))))
    return out.withColumn("found", F.coalesce(*found)).select(id_column, F.col("found.id").alias("match_id"), F.col("found.by").alias("matched_by"))


def validate_scope(asked: DataFrame, papers: DataFrame, user: str) -> DataFrame:
    """``paper_id, problem`` of asked papers: missing, not_done, forbidden, or null where it may be used.

    ``papers`` has ``paper_id, status, user_id``; those of nobody, of ``system`` and of the user are open.
    """
    first = asked.select("paper_id").distinct()
    joined = first.join(papers.select("paper_id", "status", "user_id", F.lit(True).alias("there")), "paper_id", "left")
    open_ = F.col("user_id").isNull() | F.col("user_id").isin("system", user)
    problem = F.when(F.col("there").isNull(), "missing").when(F.col("status") != "done", "not_done").when(~open_, "forbidden")
    return joined.select("paper_id", problem.alias("problem"))


def resolve_redirects(entries: DataFrame, hops: int = 10) -> DataFrame:
    """``entry_id, target_id`` along ``merged_into``, at most ``hops`` steps; cycles stop where they close.

    Steps are doubled, and the powers of two that make up ``hops`` are taken one after the other: ten hops
    are three doublings and two joins.
    """
    power = entries.select("entry_id", F.coalesce("merged_into", "entry_id").alias("target_id"))
    out = entries.select("entry_id", F.col("entry_id").alias("target_id"))

    def follow(a: DataFrame, b: DataFrame) -> DataFrame:
        step = b.select(F.col("entry_id").alias("mid"), F.col("target_id").alias("far"))
        return a.join(step, F.col("target_id") == F.col("mid"), "left").select("entry_id", F.coalesce("far", "target_id").alias("target_id"))

    while hops:
        out = follow(out, power) if hops & 1 else out
        hops >>= 1
        power = follow(power, power) if hops else power
    return out


def merge_edges(edges: DataFrame, source: Column, target: Column, owner: str = "entry_id") -> DataFrame:
    """Edges of ``source`` move to ``target``; those it has already stay once."""
    return edges.withColumn(owner, F.when(F.col(owner) == source, target).otherwise(F.col(owner))).dropDuplicates()


def append_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new.select(*old.columns).distinct().join(old, old.columns, "left_anti"))


def compose(entries: DataFrame, edges: DataFrame, value: str, order: str, name: str) -> DataFrame:
    """Entries with their edges as an ordered array, empty where they have none."""
    lists = edges.groupBy("entry_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias(name))
    return entries.join(lists, "entry_id", "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def cascade_counts(levels: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """``table_name, n`` for a delete that reaches several tables."""
    out = None
    for name, frame in levels:
        one = frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def concept_issues(entries: DataFrame, min_chars: int = 40) -> DataFrame:
    """``entry_id, issues`` of entries with ``definition, n_papers, version, n_evidence, labels, related``."""
    short = F.length(F.trim(F.coalesce("definition", F.lit("")))) < min_chars
    checks = F.array_compact(
        F.array(
            F.when(short, "definition_too_short"),
            F.when(F.col("n_papers") == 0, "no_key_papers"),
            F.when((F.col("version") > 10) & (F.col("n_evidence") == 0), "high_version_no_evidence"),
            F.when(F.exists("labels", lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}]", "") == ""), "empty_normalized_label"),
            F.when(F.array_contains("related", F.col("entry_id")), "self_related"),
        )
    )
    return entries.select("entry_id", checks.alias("issues")).where(F.size("issues") > 0)


def pair_assets(figures: DataFrame, layout: DataFrame) -> DataFrame:
    """Figure references with what the layout says of the asset; its tables turn figures into tables.

    ``figures`` has ``asset``, ``layout`` has ``path, kind, page``; they meet by the last part of the path.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    known = layout.select(base(F.col("path")).alias("name"), "kind", "page").dropDuplicates(["name"])
    joined = figures.join(known, base(figures["asset"]) == known["name"], "left").drop("name")
    return joined.withColumn("modality", F.when(F.col("kind") == "table", "table").otherwise("figure"))


def authorised(traces: DataFrame, trace_id: Column, tenant: Column, user: Column, now: Column) -> DataFrame:
    """A stored trace for its own tenant and user while it lives; others fail at run time."""
    bad = F.when(F.col("expires_at") <= now, "expired").when((F.col("tenant") != tenant) | (F.col("user_id") != user), "permission denied")
    checked = F.when(bad.isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(True)
    return traces.where(F.col("trace_id") == trace_id).withColumn("ok", checked).where("ok").drop("ok")
