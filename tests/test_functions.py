"""Literal cases of text functions, segmentation, ranking rules, stores and streams."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvine.functions import chunking, models
from corvine.functions import text as T
from corvine.operators import concepts, operations
from corvine.operators import evaluation as E
from corvine.operators import retrieval as R
from corvine.operators import store as S
from corvine.operators.topk import TopK
from corvine.plans import answer
from corvine.sources import files, identifiers
from corvine.streaming import events, ingest, queue


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,out", [("长程依赖建模", "长程 程依 依赖 赖建 建模"), ("图", "图"), ("长程，依赖", "长程 ， 依赖"), ("Graph 图神经 x", "Graph 图神 神经 x")])
def test_segment_cjk(spark, text, out):
    assert one(spark, T.segment_cjk(F.col("t")), t=text) == out


@pytest.mark.parametrize("query,out", [("Graph-Mamba", '"Graph" OR "Mamba"'), ("长程依赖", '"长程 程依 依赖"'), ("图", '"图"*'), ("Mamba模型", '"Mamba" OR "模型"'), ("!?@#", '""')])
def test_match_atoms(spark, query, out):
    assert one(spark, T.match_atoms(F.col("q")), q=query) == out


def test_long_runs_become_bags(spark):
    assert one(spark, T.match_atoms(F.col("q")), q="一二三四五六七八九").count(" OR ") == 7
    assert " OR " not in one(spark, T.match_atoms(F.col("q")), q="一二三四五六")


def test_reference_sections_and_intent(spark):
    for section, want in ((" References ", True), ("BIBLIOGRAPHY", True), ("参 考 文 献", True), ("Reference Architecture", False)):
        assert one(spark, T.is_reference(F.col("s")), s=section) is want
    assert one(spark, T.is_reference(F.col("s"), F.lit(False)), s="References") is False
    for question, want in (("show the bibliography", True), ("which papers are cited here", True), ("参考文献有哪些", True), ("a reference model", False), ("who cited works", True)):
        assert one(spark, T.reference_intent(F.col("q")), q=question) is want


def test_ids(spark):
    assert one(spark, T.chunk_id(F.lit("p1"), F.lit(0), F.lit("text"), F.lit(0))) == hashlib.sha1(b"p1::0::text::0").hexdigest()[:20]
    space = uuid.NAMESPACE_URL
    assert one(spark, T.uuid5(str(space), F.lit("a:b"))) == str(uuid.uuid5(space, "a:b"))
    assert one(spark, T.doi(F.lit("https://doi.org/10.1/AbC"))) == "10.1/abc"
    assert one(spark, T.arxiv_id(F.lit("arXiv:2101.00001v2"))) == "2101.00001"
    assert one(spark, T.with_context(F.lit("x"), F.lit("Demo Paper"), F.lit("Introduction"))) == "[Title: Demo Paper] [Section: Introduction]\nx"


def test_citations(spark):
    said = "a [chunk:c1] b [chunk:zz] c [chunk:c1] d [chunk:c2]"
    got = F.array(F.lit("c1"), F.lit("c2"))
    assert one(spark, T.valid_citations(F.col("a"), got), a=said) == ["c1", "c2"]
    assert "zz" not in one(spark, T.without_invalid(F.col("a"), got), a=said)
    assert one(spark, T.suspicious(F.col("a"), "numeric"), a="As shown in [1] and [12]; [x], [1234]") == ["[1]", "[12]"]
    assert one(spark, T.without_suspicious(F.col("a")), a="seen (Vaswani et al., 2017) here [3] .") == "seen here."


def test_intents(spark):
    for question, want in (("what is RAG", "factual"), ("compare A and B", "reasoning"), ("a survey of what is new", "explore"), ("hello", "reasoning"), ("区别是什么", "reasoning"), ("研究进展", "explore")):
        assert one(spark, T.intent(F.col("q")), q=question) == want


def test_chunks_keep_spans_and_overlap():
    body = "\n\n".join(c * 32 for c in "abc")
    assert [body[a:b] for a, b in chunking.chunk_spans(body, None, 20)] == [f"{'a' * 32}\n\n{'b' * 32}", f"{'b' * 32}\n\n{'c' * 32}"]
    text = "One two. Three four! " * 200 + "\n\n" + "字" * 1500
    for a, b in chunking.chunk_spans(text, None, 100):
        assert text[a:b] == text[a:b].strip() and chunking.tokens(text[a:b]) <= 200
    assert chunking.chunk_spans("") == []


def test_sections():
    md = "lost line\n# Introduction\nx\n## 2. Approach\ny\n#### Details\nz\n# References\nr\n# Not a section\n# Appendix A\nq"
    found = chunking.sections(md)
    assert [(s["name"], s["level"]) for s in found] == [("Introduction", 1), ("Approach", 2), ("Details", 4), ("References", 1), ("Appendix A", 1)]
    assert all(md[s["start"] : s["end"]] == md[s["start"] : s["end"]].strip() for s in found)
    assert chunking.sections("no heading here")[0]["name"] == "Body"
    plain = "Abstract: short\n\n1. Introduction\ntext\n\n2.1 Evaluation Setup\nmore\n\nReferences\n[1] x"
    assert [(s["name"], s["level"]) for s in chunking.sections(plain, "en")] == [("Abstract", 1), ("Introduction", 1), ("Evaluation Setup", 2), ("References", 1)]
    zh = "摘要：内容\n\n一、引言\n正文\n\n1.1实验设置\n正文\n\n参考文献\n[1]"
    assert [(s["name"], s["level"]) for s in chunking.sections(zh, "zh")] == [("摘要", 1), ("引言", 1), ("实验设置", 2), ("参考文献", 1)]


def test_grades_media_and_pages():
    assert chunking.grade(["Abstract", "Method", "Results", "Conclusion"]) == "complete"
    assert chunking.grade(["Introduction", "Approach", "Experiments"]) == "partial"
    assert chunking.grade(["Introduction"]) == "minimal" and chunking.grade(["x"]) == "broken"
    body = "see ![a](img/x.png) and\n|a|b|\n|-|-|\n|1|2|\n\n$$e=mc^2$$\n|Q|\n|Q|\n"
    found = chunking.media_spans(body)
    assert [m["modality"] for m in found] == ["figure", "table", "formula"]
    assert body[found[1]["start"] : found[1]["end"]] == "|a|b|\n|-|-|\n|1|2|"
    paged = chunking.inject_pages("first words and second words", [(0, "first"), (1, "second"), (1, "words")])
    assert chunking.page_of(paged, paged.index("second")) == 2 and chunking.page_of(paged, 0) == 1


def test_dense_takes_more_queries_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(R, "MOST_QUERIES", 3)
    points = [(i, [float(i % 7) - 3, float(i % 5) - 2, 1.0]) for i in range(40)]
    asked = [(q, [float(q % 3) - 1, float(q % 4), 0.5]) for q in range(10)]
    frames = [spark.createDataFrame(rows, f"{name} long, vector array<double>").repartition(2) for rows, name in ((points, "chunk_id"), (asked, "query_id"))]
    got = R.dense(*frames, 4).collect()
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    cosine = lambda a, b: round(sum(x * y for x, y in zip(unit(a), unit(b), strict=True)), 9)
    want = {(q, c, n) for q, v in asked for n, (_, c) in enumerate(sorted((-cosine(v, p), c) for c, p in points)[:4])}
    assert {(r["query_id"], r["chunk_id"], r["rank_dense"]) for r in got} == want and len(got) == 40
    assert R.dense(frames[0], frames[1].where("query_id < 0"), 4).count() == 0


def test_fusion_and_pool(spark):
    dense = spark.createDataFrame([(1, "a", 0, 0.9), (1, "b", 1, 0.8)], "query_id long, chunk_id string, rank int, score_dense double")
    sparse = spark.createDataFrame([(1, "a", 0, 5.0), (1, "c", 1, 4.0)], "query_id long, chunk_id string, rank int, score_bm25 double")
    got = {r["chunk_id"]: r for r in R.rrf([(dense, "rank"), (sparse, "rank")], keep=("score_dense", "score_bm25")).collect()}
    assert got["a"]["score_rrf"] == pytest.approx(2 / 61) and got["b"]["score_rrf"] == got["c"]["score_rrf"] == pytest.approx(1 / 62)
    assert got["a"]["score_bm25"] == 5.0 and got["a"]["score_dense"] == 0.9
    runs = spark.createDataFrame([(1, "a", 0.1, 0), (1, "b", 0.3, 1), (1, "a", 0.9, 2)], "query_id long, chunk_id string, score_rrf double, seq int")
    assert {r["chunk_id"]: r["score_rrf"] for r in R.pool(runs).collect()} == {"a": 0.9, "b": 0.3}


def test_penalty_and_quota(spark):
    rows = spark.createDataFrame([(1, "r", "References", 0.9), (1, "b", "Body", 0.4)], "query_id long, chunk_id string, section string, score_rerank double")
    assert {r["chunk_id"]: round(r["score_effective"], 6) for r in R.penalise(rows).collect()} == {"r": 0.135, "b": 0.4}
    assert {r["chunk_id"]: r["score_effective"] for r in R.penalise(rows, intent=F.lit(True)).collect()} == {"r": 0.9, "b": 0.4}
    many = spark.createDataFrame([(1, f"p1-{i}", "p1", i) for i in range(51)] + [(1, "p2-0", "p2", 51)], "query_id long, chunk_id string, paper_id string, n int")
    out = [r["chunk_id"] for r in R.diversify(many, 50, 51, [F.asc("n")]).orderBy("position").collect()]
    assert out == [f"p1-{i}" for i in range(50)] + ["p2-0"]


def test_decisions(spark):
    rows = lambda v: spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "query_id long, chunk_id long, score_rerank double")
    for values, want in (([0.9, 0.8, 0.7], "confident"), ([0.3, 0.3, 0.3], "weak_evidence"), ([0.1, 0.1], "no_evidence"), ([0.48] * 3, "confident"), ([0.21] * 3, "weak_evidence")):
        assert R.decide(rows(values)).first()["decision"] == want
    low = rows([5.0]).withColumnRenamed("score_rerank", "score_bm25")
    assert R.decide(low).first()["signal_quality"] == "low_degraded"


def test_diff_and_uniqueness(spark):
    ddl = "point_id string, content_id string, embedding_version string, payload_fingerprint string"
    new = spark.createDataFrame([("same", "c", "v", "p"), ("page", "c", "v", "q"), ("text", "d", "v", "p"), ("new", "c", "v", "p")], ddl)
    old = spark.createDataFrame([("same", "c", "v", "p"), ("page", "c", "v", "p"), ("text", "c", "v", "p"), ("gone", "c", "v", "p")], ddl)
    assert {r["point_id"]: r["action"] for r in S.incremental_diff(new, old).collect()} == {"same": "skip", "page": "payload", "text": "vector", "new": "vector", "gone": "delete"}
    with pytest.raises(Exception, match="duplicate point_id"):
        S.assert_unique(new.union(new), "point_id").collect()


def test_metrics(spark):
    ddl = "query_id long, retrieved array<string>, retrieved_papers array<string>, expected array<string>, expected_papers array<string>, citations array<string>, decision string, expected_abstain boolean"
    row = spark.createDataFrame([(1, ["c1", "c2", "c3"], ["p1", "p2", "p2"], ["c2", "c9"], ["p2"], ["c1", "missing"], "confident", False)], ddl)
    got = E.query_metrics(row).first()
    assert (got["hit_rate"], got["mrr"], got["recall"], got["paper_hit_rate"], got["citation_precision"], got["abstain_accuracy"]) == (1, 0.5, 0.5, 1, 0.5, 1)


def test_replies(spark):
    said = 'Sure! ```{"sufficiency": "Partial", "score": "1.7", "follow_up": "x"}``` ok'
    got = one(spark, models.reflection(F.col("r")), r=said)
    assert (got["sufficiency"], got["score"], got["follow_up"]) == ("partial", 1.0, "x")
    assert one(spark, models.reflection(F.col("r")), r="nothing")["sufficiency"] == "sufficient"
    said = json.dumps({"concepts": [{"name": "A", "category": "method", "confidence": 3, "evidence": ["c1", "no"]}, {"name": "B", "category": "odd", "confidence": 1, "evidence": []}]})
    got = one(spark, models.concepts(F.col("r"), F.array(F.lit("c1"))), r=said)
    assert [(c["name"], c["confidence"], c["evidence"]) for c in got] == [("A", 1.0, ["c1"])]
    assert one(spark, models.verdict(F.col("r"), F.array(F.lit("e1"))), r='{"decision": "same", "entry_id": "e2"}') == "unsure"


def test_answer_chain(spark):
    chunks = spark.createDataFrame([(1, "p", "state space models for graphs", "Method"), (2, "q", "graphs and long range attention", "Results"), (3, "q", "graphs cited", "References"), (4, "r", "cooking rice slowly", "Method")], "chunk_id long, paper_id string, text string, section string")
    asked = spark.createDataFrame([(1, "graphs with state space models"), (2, "zzz qqq")], "query_id long, query string")
    got = {r["query_id"]: r for r in answer.answer(chunks, asked, answer.Settings(low=0.05)).collect()}
    assert "1" in got[1]["citations"] and "3" not in got[1]["evidence"] and got[2]["answer"] == ""
    seen = answer.events(answer.answer(chunks, asked)).where("query_id = 1").orderBy("seq").collect()
    assert [r["event"] for r in seen] == ["retrieved", "abstain", "answer_chunk", "done"]


def test_files(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"one")
    (tmp_path / "b.txt").write_bytes(b"two")
    got = files.scan_pdfs(spark, str(tmp_path)).collect()
    assert [(r["title"], r["paper_id"]) for r in got] == [("a", "sha1:" + hashlib.sha1(b"one").hexdigest())]
    (tmp_path / "log.json").write_text('{"run_id": "1", "created_at": "2024-01-01"}\nbroken\n{"created_at": "x"}\n{"run_id": "2", "created_at": "2024-01-02"}\n')
    assert [r["run_id"] for r in files.read_log(spark, str(tmp_path / "log.json"), "run_id string, created_at string").collect()] == ["2", "1"]
    (tmp_path / "g.json").write_text(json.dumps({"version": "1", "test_cases": [{"id": "q", "query": "x"}]}))
    assert files.read_golden(spark, str(tmp_path / "g.json"), "qa").count() == 1
    (tmp_path / "h.json").write_text(json.dumps({"schema_version": "odd", "test_cases": [{"id": "q", "query": "x"}]}))
    with pytest.raises(Exception, match="not a retrieval"):
        files.read_golden(spark, str(tmp_path / "h.json"), "retrieval.v1").collect()
    urls = spark.createDataFrame([("http://x.org/a.pdf?q=1",), ("http://x.org/a",), (None,)], "url string")
    assert {r["url"]: r["ok"] for r in files.from_urls(urls, lambda u: b"%PDF").collect()} == {"http://x.org/a.pdf?q=1": True, "http://x.org/a": False, None: False}


def bad(raw):
    raise ValueError(raw)


def test_parser_fallback(spark):
    rows = spark.createDataFrame([("a", bytearray(b"x"))], "paper_id string, content binary")
    assert files.parse_pages(rows, bad, lambda raw: "text").first()["status"] == "degraded"
    assert files.parse_pages(rows, bad, lambda raw: "<!-- page 1 -->").first()["status"] == "failed"


def test_queue_steps():
    t = pd.Timestamp("2024-01-01")
    state = queue.step(None, 0, None, None, "enqueue", t)
    assert state[0] == "pending"
    for attempt, status in ((1, "pending"), (2, "pending"), (3, "failed")):
        at = state[2] or t
        state = queue.step(*queue.step(*state, "claim", at), "fail", at)
        assert (state[0], state[1]) == (status, attempt)
    busy = queue.step("pending", 0, None, t, "claim", t)
    assert queue.step(*busy, "claim", t + pd.Timedelta(hours=2))[0] == "processing"
    assert queue.step(*busy, "claim", t + pd.Timedelta(minutes=1))[3] == t


def drained(query):
    query.awaitTermination(120)
    return query


def test_streams(spark, tmp_path):
    rows = [(1, "click", "2024-01-01 00:10:00", 1.0), (1, "click", "2024-01-01 00:20:00", 2.0), (2, "view", "2024-01-01 05:00:00", 3.0)]
    frame = spark.createDataFrame(rows, "user_id long, event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    drained(events.windowed(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start())
    assert {(r["event_type"], r["n"], r["total"]) for r in spark.table("w").collect()} == {("click", 2, 3.0), ("view", 1, 3.0)}
    jobs = spark.createDataFrame([("p", "f", "enqueue", "2024-01-01 00:00:00"), ("p", "f", "claim", "2024-01-01 00:00:01"), ("p", "f", "done", "2024-01-01 00:00:02")], "paper_id string, fingerprint string, event string, at string").withColumn("at", F.to_timestamp("at"))
    jobs.coalesce(1).write.parquet(str(tmp_path / "jobs"))
    drained(queue.queue(spark.readStream.schema(jobs.schema).parquet(str(tmp_path / "jobs"))).writeStream.format("memory").queryName("jobs").outputMode("update").trigger(availableNow=True).start())
    assert spark.table("jobs").collect()[-1]["status"] == "done"
    docs = spark.createDataFrame([(1, "Hello there.", "en"), (1, "Hello there.", "en"), (2, "Bye.", "en")], "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "docs"))
    drained(ingest.ingest(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs")), str(tmp_path / "out"), str(tmp_path / "cp")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


@pytest.mark.parametrize(
    ("name", "numbered", "plain"),
    [
        ("The Quick Brown Fox", False, False), ("Notes", False, False), ("results are shown below", False, False), ("Method (Ours)", False, False),
        ("Method", True, True), ("Appendix B", True, True), ("Query tuning of the decoder", True, False), ("RELATED SYSTEMS", True, False),
        ("Table 3 results", False, False), ("Training -", False, False), ("Training " * 13, False, False),
    ],
)
def test_heading_rules(name, numbered, plain):
    assert (chunking.is_heading(name, True), chunking.is_heading(name)) == (numbered, plain)


def test_zh_heading_rules():
    assert [chunking.is_zh_heading(x) for x in ("系统的总体设计", "表3结果", "倍的提升", "设计（初稿）", "甲，乙", "a" * 5, "图" * 31, "摘 要")] == [True, False, False, False, False, False, False, True]
    assert chunking.clean_heading("##  2.1  Two   words. ") == "Two words" and chunking.clean_heading("1综合能源服务") == "综合能源服务" and chunking.clean_heading("2023年报告") == "2023年报告"


def test_plain_headings_need_gaps_and_an_abstract():
    text = "Some Title\n1.\nFancy Training Setup\nAbstract\nwords\n2.\nPrompt Tuning Works\nbody\nConclusion\nmore\n\nResults\nTable 1 rows\n\nAnalysis\n\nReferences\n3. Query Training\n\nAppendix A\n"
    assert [(n, level) for _, _, n, level in chunking.plain_headings(text, "en")] == [("Abstract", 1), ("Prompt Tuning Works", 1), ("Results", 1), ("References", 1), ("Query Training", 1), ("Appendix A", 1)]
    assert [s["name"] for s in chunking.sections(text, "en")] == ["Abstract", "Prompt Tuning Works", "Results", "References", "Appendix A"]
    assert [n for _, _, n, _ in chunking.plain_headings("正文\n一、系统设计方案\n\n二、实验平台\n（三）细节说明", "zh")] == ["实验平台"]


def test_redirects_stop_after_ten_hops(spark):
    chain = spark.createDataFrame([(i, i + 1 if i < 30 else None) for i in range(31)] + [(100, 101), (101, 100), (102, 999)], "entry_id long, merged_into long")
    got = {r["entry_id"]: r["target_id"] for r in S.resolve_redirects(chain).collect()}
    assert (got[0], got[14], got[20], got[25], got[30], got[100], got[102]) == (10, 24, 30, 30, 30, 100, 999)


def test_window_dedupe_compares_with_what_was_kept(spark):
    hour = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(i, k, hour(h)) for i, (k, h) in enumerate([("a", 0), ("a", 20), ("a", 40), ("a", 63), ("a", 65), ("b", 0), ("b", 24), ("b", 49), (None, 1), (None, 2)])] + [(99, "a", None)]
    frame = spark.createDataFrame(rows, "id long, kind string, ts timestamp").repartition(3)
    assert sorted(r["id"] for r in operations.first_in_window(frame, ["kind"], "ts", 86400, "id").collect()) == [0, 2, 4, 5, 7, 8, 99]


def test_concept_texts(spark):
    long_ = "word " * 400
    rows = [(1, "ＲＬ-Straße ②", f"{long_}[chunk:a]"), (2, None, None), (3, "İx", "Attention (chunk: b) is a mechanism 本文提出一种注意力机制的方法问题 for sequence models"), (4, "", "short [ chunk:c ]")]
    out = spark.createDataFrame(rows, "id int, label string, text string").select(
        "id", concepts.label_norm(F.col("label")).alias("norm"), concepts.clip_definition(F.col("text")).alias("clip"), concepts.definition_phrases(F.col("text")).alias("phrases"),
        concepts.mask_message(F.col("text"), ["word", None, ""]).alias("masked"),
    ).collect()
    assert [r["norm"] for r in out] == ["rlstrasse2", "", "ix", ""]
    assert out[0]["clip"] == ("word " * 400)[:1197].rstrip() + "..." and out[1]["clip"] == "" and out[3]["clip"] == "short"
    assert out[2]["phrases"] == ["attention chunk mechanism sequence models", "mechanism sequence models", "注意力机制的方法"]
    assert out[0]["masked"].startswith("*** ***")


def test_scrubbing_reaches_every_depth(spark):
    rows = [('{"a":[{"Api-Key":1,"b":{"secret":2,"c":3}}],"password_hash":4}',), ("[1,{\"prompt\":2}]",), ("no json",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(concepts.scrub_json(F.col("t"))).collect()]
    assert got == ['{"a":[{"b":{"c":3}}]}', "[1,{}]", None, None]


def test_failure_classes_have_hints(spark):
    said = ["No module named 'cv2'", "no module named ultralytics", "No such file or directory: 'magic-pdf'", "ConnectionError https://huggingface.co", "Model weights not found", "odd", None]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "s string").select(identifiers.failure(F.col("s"), "py3")).collect()]
    assert [r["category"] for r in got] == ["missing_cv2", "missing_mineru_full_extra", "missing_cli", "missing_models_or_offline", "missing_models", "unknown", "unknown"]
    assert "py3 -m pip" in got[0]["hint"] and got[5]["hint"] == "" and all(r["hint"] for r in got[:5])


def test_index_terms_are_the_columns(spark):
    texts = ["Graph-Mamba 长程依赖建模 x", "图", "长程，依赖 A_b 3", "", None, "Kelvin \u212a ÀB İ 模型x模型名", "  \n\t "]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.index_tokens(F.col("t"))).collect()]
    assert [x or [] for x in got] == [T.index_terms(t) for t in texts]


def test_texts_are_found_in_chunks(spark):
    chunks = spark.createDataFrame([(1, "p", "the cat sat"), (2, "q", "cat"), (3, "q", None), (4, None, "")], "chunk_id long, paper_id string, text string")
    asked = spark.createDataFrame([(1, "cat"), (2, "cat sat"), (3, "dog"), (4, None), (5, "cat"), (6, "")], "query_id long, query string")
    got = sorted((r["query_id"], r["chunk_id"]) for r in R.containing(chunks, asked).collect())
    assert got == [(1, 1), (1, 2), (2, 1), (5, 1), (5, 2), (6, 1), (6, 2), (6, 4)]
    phrases = asked.select(F.col("query_id").alias("phrase_id"), F.col("query").alias("phrase"))
    assert sorted(map(tuple, R.phrase_hits(chunks, phrases).collect())) == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (5, 1, 1), (5, 2, 1)]


def test_top_k_keeps_the_best_with_ties():
    rng = np.random.default_rng(5)
    scores = np.round(rng.random((200, 7)) * 10)
    scores[rng.random(scores.shape) < 0.3] = -np.inf
    top = TopK(7, 9)
    for a in range(0, 200, 33):
        top.offer(scores[a : a + 33], np.arange(a, min(a + 33, 200)) * 3)
    got = top.batch(np.arange(7) + 50, ["q", "row", "s"]).to_pylist()
    for q in range(7):
        want = sorted((-s, i * 3) for i, s in enumerate(scores[:, q]) if s > -np.inf)[:9]
        assert [(-r["s"], r["row"]) for r in got if r["q"] == q + 50] == want


def test_rounds_follow_up_until_the_evidence_suffices(spark):
    from pyspark.sql import functions as F

    from corvine.operators import index
    from corvine.operators import retrieval as R
    from corvine.plans import answer

    chunks = spark.createDataFrame([(1, "a", "alpha beta", "Intro", "T", "text"), (2, "b", "gamma delta", "Intro", "T", "text")], "chunk_id long, paper_id string, text string, section string, title string, modality string")
    asked = spark.createDataFrame([(1, "alpha"), (2, "gamma")], "query_id long, query string")
    reply = lambda q, e: F.when(q == "alpha", '{"sufficiency": "partial", "follow_up": "gamma"}').otherwise('{"sufficiency": "sufficient"}')
    rows, log = answer.loop(chunks, asked, answer.Settings(top_k=1), reply)
    seen = sorted((r["query_id"], r["round"], r["query"], r["stopped_by"]) for r in log.collect())
    assert seen == [(1, 0, "alpha", None), (1, 1, "gamma", None), (1, 2, "gamma", "answered"), (2, 0, "gamma", "answered")]
    assert {(r["query_id"], r["chunk_id"], r["round"], r["query"]) for r in rows.collect()} == {(1, 1, 0, "alpha"), (1, 2, 1, "alpha"), (2, 2, 0, "gamma")}
    failed = answer.answer(chunks, asked, answer.Settings(low=0.0), chat=lambda p: F.lit(None).cast("string"), reflect=reply).collect()
    assert {r["stopped_by"] for r in failed} == {"chat_error"} and {r["answer"] for r in failed} == {""}
    as_rows = lambda f: sorted(map(tuple, f.collect()))
    assert as_rows(R.bm25(index.rows(chunks), asked)) == as_rows(R.bm25(chunks, asked))


@pytest.mark.parametrize("values", [[3.0], [1.0, 1.0, 1.0, 2.0], [5.0, float("nan"), 1.0, float("inf"), float("-inf"), None], [None], [float(i * i % 97) for i in range(500)]])
def test_quantiles_are_those_of_the_sorted_list(spark, values):
    frame = spark.createDataFrame([(None, v) for v in values] + [("other", 1.0)], "k string, v double")
    row = E.index_quantiles(frame, "k", "v", (0.0, 0.5, 0.95, 1.0)).where("k is null").first()
    own = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
    want = [own[min(len(own) - 1, int(q * len(own)))] if own else None for q in (0.0, 0.5, 0.95, 1.0)]
    assert [repr(row[f"p{n}"]) for n in (0, 50, 95, 100)] == [repr(w) for w in want]


def test_reports_are_compared_with_their_like(spark, tmp_path):
    def report(name, mean, judge="m", version="ragas-report.v1"):
        made = {"schema_version": version, "evaluation": {"judge_model": judge, "ragas_version": "1"}, "aggregate_metrics": {"faithfulness": {"mean": mean, "coverage": 0.5}}}
        (tmp_path / name).write_text(json.dumps(made))
        return E.read_report(spark, str(tmp_path / name), name)

    now, before = report("now", 0.7), report("before", 0.9)
    got = E.report_gates(now, {"faithfulness": 0.75}, {"faithfulness": 0.5}, {"faithfulness": 0.1}, before).collect()
    assert [(r["gate"], r["actual"], r["baseline"], r["bound"]) for r in got] == [("fail_under", 0.7, None, 0.75), ("max_regression", 0.7, 0.9, 0.1)]
    assert E.report_gates(now, {"faithfulness": 0.7}, {}, {}).collect() == []
    for make, problem in (
        (lambda: E.report_gates(now, {}, {}, {"faithfulness": 0.1}, report("other", 0.9, judge="n")), "mismatched: judge_model"),
        (lambda: E.report_gates(now, {"recall": 0.1}, {}, {}), "does not contain metric: recall"),
        (lambda: report("old", 0.9, version="v0"), "must use schema"),
    ):
        with pytest.raises(Exception, match=problem):
            make().collect()
    with pytest.raises(ValueError, match="baseline"):
        E.report_gates(now, {}, {}, {"faithfulness": 0.1})


def test_settled_reviews_hold_back_nothing(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(1, "k", at(0), False), (2, "k", at(1), True), (3, "k", at(2), True), (4, "k", at(25), True), (5, "k", at(25.5), None), (6, "j", at(2), True)]
    frame = spark.createDataFrame(rows, "id int, kind string, at timestamp, pending boolean")
    assert {r["id"] for r in operations.first_in_window(frame, ["kind"], "at", 86400, "id", "pending").collect()} == {1, 2, 5, 6}
    assert {r["id"] for r in operations.first_in_window(frame, ["kind"], "at", 86400, "id").collect()} == {1, 4, 6}
