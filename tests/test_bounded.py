"""What tasks hold and send stays small against the input."""

from __future__ import annotations

import re
import timeit
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corvine.functions import text as T
from corvine.functions.batches import pieces
from corvine.llm import ngram_join as N
from corvine.operators import context as K
from corvine.operators import postings as P
from corvine.operators import retrieval as R
from corvine.operators.ingest import Ingest
from corvine.operators.topk import TopK
from corvine.operators.versions import Versions
from corvine.plans import catalogue
from corvine.sources import identifiers as I


def test_inverted_texts_are_made_inside_the_row(spark, tmp_path):
    rows = [(1, "b a b"), (2, None), (3, ""), (4, "12 ?"), (5, "One one two"), (5, "two"), (6, "x " * 3000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    frame = catalogue.queries()["abstract_decode"](spark, str(tmp_path))
    assert dict(frame.collect()) == {1: "b a b", 5: "one two one two", 6: " ".join(["x"] * 3000)}
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan


def test_a_map_of_words_to_places(spark):
    made = spark.range(1).select(I.encode_inverted(F.array(F.array(*map(F.lit, "babc")))).alias("m")).first()["m"]
    assert made == {"a": [1], "b": [0, 2], "c": [3]}


def test_batches_come_in_pieces():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 100_000] * 30 + ["y"] * 2000})
    parts = list(pieces([batch, batch.slice(0, 0)]))
    assert sum(p.num_rows for p in parts) == batch.num_rows and max(p.num_rows for p in parts) <= 256
    assert max(p.num_rows for p in pieces([batch.slice(0, 30)])) <= 10


def test_a_shard_comes_in_portions():
    batch = pa.RecordBatch.from_pydict({"shard": pa.array([0] * 600 + [1] * 3, pa.int32()), "terms": [["a", "b"]] * 603, "id": list(range(603))})
    got = [(s, t.column("id").to_pylist()) for s, t in P.by_shard([batch], 100)]
    assert [i for _, own in got for i in own] == list(range(603)) and [s for s, _ in got].count(0) > 1 and got[-1] == (1, [600, 601, 602])
    assert [s for s, _ in P.by_shard([batch])] == [0, 1]


def test_a_shard_of_many_runs_finds_the_same(spark, tmp_path, monkeypatch):
    rows = [(i, f"p{i % 7}", " ".join(f"w{(i * k) % 23}" for k in range(1, 9))) for i in range(600)]
    chunks = spark.createDataFrame(rows, "chunk_id long, paper_id string, text string")
    asked = spark.createDataFrame([(1, "w3 w5"), (2, "w1 w2 w22 w22"), (3, "none")], "query_id long, query string")
    whole = P.inverted
    monkeypatch.setattr(P, "inverted", lambda docs: whole(docs, 200))
    index = P.Index(spark, str(tmp_path / "ix")).build(chunks.withColumn("text", F.when(F.col("paper_id") == "p3", F.lit("w3 w3 w5")).otherwise(F.col("text"))), "plain", shards=1)
    assert index.table("postings").groupBy("shard", "term").count().agg(F.max("count")).first()[0] > 1  # in one run each term has one block
    index.sync(chunks, spark.createDataFrame([("p3",)], "paper_id string"))
    got, want = ([tuple(r) for r in f.orderBy("query_id", "rank_bm25").collect()] for f in (index.search(asked, "fts", 20), R.bm25(chunks, asked, "fts", 20)))
    assert len(got) == 40 and [(*r[:3], round(r[3], 6), r[4]) for r in got] == [(*r[:3], round(r[3], 6), r[4]) for r in want]
    assert {r["term"]: r["df"] for r in index.frequencies().collect()} == {r["t"]: r["count"] for r in chunks.select("chunk_id", F.explode(F.split("text", " ")).alias("t")).distinct().groupBy("t").count().collect()}


def test_shards_follow_characters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "SHARD_CHARS", 100)
    chunks = spark.createDataFrame([(i, "p", "word " * 50) for i in range(8)], "chunk_id long, paper_id string, text string")
    assert P.Index(spark, str(tmp_path / "ix")).build(chunks, "plain").settings()[1] == 20


def test_frequencies_of_asked_terms_only(spark):
    texts = spark.createDataFrame([("a b c",), ("a c d",), (None,)], "text string")
    n, mean, df, _ = R._statistics(texts, False, {"a", "d", "z"})
    assert (n, mean) == (3, 2.0) and {r["term"]: r["df"] for r in df.where("term is not null").collect()} == {"a": 2, "d": 1}


def test_first_scores_of_a_search_take_little_memory():
    queries = 256
    scores, rows = np.random.default_rng(1).random((R.MOST_SCORES // queries, queries)), np.arange(R.MOST_SCORES // queries)
    tracemalloc.start()
    TopK(queries, 20).offer(scores, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20


def test_first_index_of_a_store_has_shards_by_its_points(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "SHARD_ROWS", 1)
    index = P.Index(spark, str(tmp_path / "ix"))
    into = Ingest(Versions(spark, str(tmp_path / "store")), index)
    into.run(spark.createDataFrame([(f"p{i}", f"Title {i}", f"# Method\n\nSome words {i}.") for i in range(6)], "paper_id string, title string, markdown string"))
    points = into.points().count()
    assert points == 12 and index.settings()[1] == points and index.totals()[0] == points and index.mark() == into.store.last()


def test_a_packet_of_fingerprints_is_sent_in_portions():
    grams, buckets = 2_500_000, 40
    rng = np.random.default_rng(1)
    mark, bucket, owner = rng.integers(0, 1 << 32, grams, dtype=np.uint32), rng.integers(0, buckets, grams, dtype=np.int32), np.sort(rng.integers(0, 40_000, grams)).astype(np.uint16)
    held = [np.array_split(x, 20) for x in (mark, bucket, owner)]
    got, peak = [], 0
    tracemalloc.start()
    for batch in N._by_bucket(*held, 7):
        got += [(b, np.frombuffer(m, np.uint32), np.cumsum(np.frombuffer(w, np.uint16), dtype=np.uint16)) for b, m, w in zip(batch["key"].to_pylist(), batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True)] if batch["key"][0].as_py() < 3 else []
        assert batch.nbytes < 6.5 * 2 * N.PORTION
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20 and not any(held) and [b for b, _, _ in got][:3] == [0, 1, 2]
    for b, m, w in got:
        assert (m == mark[bucket == b]).all() and (w == owner[bucket == b]).all()


def test_pairs_of_questions_and_entries_are_dealt_by_the_rows_of_evidence(spark, monkeypatch):
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    questions = frame([(q, "abcdef") for q in range(3)], "query_id long, question_norm string")
    hits = frame([(q, c, c % 4) for q in range(3) for c in range(q, 40, 2)], "query_id long, chunk_id long, paper_id long")
    entries = frame([(e, "cd" if e == 7 else "x", 3 if e == 2 else None) for e in range(10)], "entry_id long, name_norm string, merged_into long")
    labels = frame([(8, "ab"), (8, "ab"), (9, "")], "entry_id long, label_norm string")
    papers = frame([(e, e % 6) for e in range(6)], "entry_id long, paper_id long")
    evidence = frame([(e, c) for e in range(3) for c in range(0, 40, e + 1)] * 2, "entry_id long, chunk_id long")
    monkeypatch.setattr(K, "TASK_ROWS", 10)
    out = K.evidence_context(questions, hits, entries, labels, papers, evidence, most=9)
    even, odd = {0: 311, 1: 310, 7: 100, 8: 100}, {0: 310, 1: 201, 3: 201, 7: 100, 8: 100}
    assert {(r["query_id"], r["entry_id"]): r["score"] for r in out.collect()} == {(q, e): s for q, own in enumerate((even, odd, even)) for e, s in own.items()}
    tasks = -(-evidence.count() // 10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert f"hashpartitioning(query_id, entry_id, {tasks})" in re.sub(r"#\d+L?", "", plan)


def test_terms_are_the_patterns_and_take_half_its_time():
    pattern = lambda text: T._TERMS.findall(T.segmented(text or "").lower())
    odd = [None, "", " ", "A_b-9\x00\x1c\x85c", "\u212aelvin \u0130x \u017ft \ud800z", "Ñandú ción", "x中文字符y Ab", "ａＢ１", "ﬁne ß²"]
    rng = np.random.default_rng(3)
    odd += ["".join(map(chr, rng.choice([*range(128), 0xF1, 0x130, 0x212A, 0x3FF, 0x1F600], 200))) for _ in range(300)]
    assert [T.index_terms(t) for t in odd] == [pattern(t) for t in odd]
    text = "Ciónos dollga, ñarie the ndorea_9 asmimente. " * 2000
    took = lambda f: min(timeit.repeat(lambda: f(text), number=3, repeat=5))
    assert took(T.index_terms) < took(pattern) / 2
