"""Visual enrichment: admission, requests, fallback, cache."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvine.operators import visual as V

CHUNKS = "paper_id string, chunk_id string, seq int, modality string, asset string, text string, context_text string, metadata string"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        ("p", "1", 1, "figure", "a.png", "Figure: a plot\nContext: around", "c1", '{"caption": "told"}'), ("p", "2", 2, "figure", None, "x", "c2", None), ("p", "3", 3, "table", "none.png", "x", "c3", None),
        ("p", "4", 4, "figure", "big.png", "x", "c4", None), ("p", "5", 5, "table", "b.png", "Table:\n\n| a |\nContext: near", "c5", "{}"), ("p", "6", 6, "figure", "a.png", "x", "c6", None), ("p", "7", 7, "figure", "big.png", "x", "c7", None),
        ("p", "8", 8, "text", None, "words", "c8", None), ("q", "1", 1, "figure", "bad.png", "just words", "", None),
    ]
    return spark.createDataFrame(rows, CHUNKS)


@pytest.fixture(scope="module")
def assets(spark):
    return spark.createDataFrame([("a.png", 10, "d1"), ("b.png", 20, "d2"), ("big.png", 99, "d3"), ("bad.png", 5, "d4")], "asset string, size long, digest string")


def test_reasons_in_their_order(chunks, assets):
    got = {(r["paper_id"], r["chunk_id"]): r["reason"] for r in V.admitted(chunks, assets, 2, 50).collect()}
    assert got == {
        ("p", "1"): None, ("p", "2"): "missing asset_path", ("p", "3"): "asset not found: none.png", ("p", "4"): "image exceeds max_image_bytes=50", ("p", "5"): None,
        ("p", "6"): "max_images_per_paper=2 reached", ("p", "7"): "max_images_per_paper=2 reached", ("q", "1"): None,
    }


def test_captions_and_surroundings_are_found(chunks, assets):
    got = {(r["paper_id"], r["chunk_id"]): (r["caption"], r["context"]) for r in V.requests(V.admitted(chunks, assets, 2, 50), "m").collect()}
    assert got == {("p", "1"): ("told", "around"), ("p", "5"): ("| a |", "near"), ("q", "1"): ("", "just words")}


def test_known_summaries_are_not_asked_for(spark, chunks, assets, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def primary(request):
        (log / request["key"]).write_text("x")
        if request["asset"] == "bad.png":
            raise ValueError("unreadable")
        return f"sees {request['caption']}" if request["asset"] == "a.png" else ""

    def fallback(request):
        if request["asset"] == "b.png":
            return "plain table"
        raise OSError("no model")

    empty = spark.createDataFrame([], "key string, summary string, provider string")
    out, fresh = V.enriched(chunks, assets, empty, primary, fallback, "m", 2, 50)
    rows = {(r["paper_id"], r["chunk_id"]): r for r in out.collect()}
    assert {k: r["visual_status"] for k, r in rows.items() if r["visual_status"] != "skipped"} == {("p", "1"): "ok", ("p", "5"): "fallback", ("p", "8"): None, ("q", "1"): "failed"}
    assert rows["p", "1"]["text"].endswith("around\nVisual summary: sees told") and rows["p", "1"]["context_text"] == "c1\nVisual summary: sees told" and rows["q", "1"]["visual_error"] == "ValueError: unreadable"
    kept = fresh.collect()
    assert [(r["summary"], r["provider"]) for r in kept] == [("sees told", "primary")] and len(list(log.iterdir())) == 3
    for file in log.iterdir():
        file.unlink()
    again, more = V.enriched(out.select(*chunks.columns), assets, spark.createDataFrame(kept, empty.schema), primary, fallback, "m", 2, 50)
    rows = {(r["paper_id"], r["chunk_id"]): r for r in again.collect()}
    assert rows["p", "1"]["visual_status"] == "cached" and rows["p", "1"]["text"].count("sees told") == 1 and more.count() == 0
    assert len(list(log.iterdir())) == 2  # what failed and what only the fallback knew
    assert V.enriched(chunks, assets, empty, primary, fallback, "m", 2, 50, "zh")[0].where(F.col("text").contains("视觉摘要: ")).count() == 2
