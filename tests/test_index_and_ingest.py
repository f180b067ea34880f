"""The kept index, stemming, the fan-out and the ingest orchestrator."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvine.functions import stemming
from corvine.operators import fanout
from corvine.operators import ingest as N
from corvine.operators import postings as P
from corvine.operators import retrieval as R
from corvine.operators.versions import Versions
from corvine.streaming.ingest import ingest_papers

#: Word pairs of the published algorithm.
STEMS = (
    "caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size "
    "hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit "
    "digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal "
    "decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr "
    "electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit "
    "replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect "
    "bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll dependencies depend"
).split()


@pytest.mark.parametrize("word,stem", list(zip(STEMS[::2], STEMS[1::2], strict=True)))
def test_stems(word, stem):
    assert stemming.stem(word) == stem


def test_terms_are_folded_and_stemmed():
    assert stemming.analyse("Dependencies: Graph-Mamba naïve ÉTÉ ǅ x_y 图神经网络 Ελλάς áb") == ["depend", "graph", "mamba", "naiv", "et", "ǆ", "x_y", "图神", "神经", "经网", "网络", "ελλας", "ab"]
    assert stemming.analyse(None) == [] and stemming.stem("is") == "is" and stemming.stem("x" * 65 + "ing") == "x" * 65 + "ing"


@pytest.fixture(scope="module", autouse=True)
def small_shuffles(spark):
    few = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", few)


# --- index ------------------------------------------------------------------------------------------------------------------------

WORDS = [f"w{i}" for i in range(40)]


def corpus(seed: int, first: int, papers: list[str], n: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(first + i, rng.choice(papers), " ".join(rng.choices(WORDS, weights=[1 / (k + 1) for k in range(40)], k=rng.randrange(0, 30))) if rng.random() > 0.05 else None) for i in range(n)]


def chunk_frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, paper_id string, text string")


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(9)
    return spark.createDataFrame([(i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 8)))) for i in range(12)] + [(50, ""), (51, "unknown"), (52, None)], "query_id long, query string")


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


def test_index_equals_the_scan_after_changes(spark, tmp_path, asked):
    """Inserted, changed, emptied and deleted papers; a generation without its last table is not there."""
    now = corpus(1, 0, ["a", "b", "c"], 120)
    index = P.Index(spark, str(tmp_path / "ix")).build(chunk_frame(spark, now), "plain", shards=3)
    for paper, rows in (("b", corpus(2, 200, ["b"], 30)), ("d", corpus(3, 300, ["d"], 25)), ("a", []), ("b", [r for r in now if r[1] == "b"][:10])):
        now = [r for r in now if r[1] != paper] + rows
        index.sync(chunk_frame(spark, now), spark.createDataFrame([(paper,)], "paper_id string"))
    frame = chunk_frame(spark, now)
    index.table("docs").drop("gen").write.parquet(str(tmp_path / "ix" / "docs" / "gen=5"))
    index.table("postings").drop("gen").write.parquet(str(tmp_path / "ix" / "postings" / "gen=5"))
    assert index.last() == 4 and rows_of(index.chunks().select("chunk_id")) == sorted((r[0],) for r in now)
    for variant in ("fts", "okapi"):
        got, want = (sorted((q, c, p, round(s, 6), r) for q, c, p, s, r in rows_of(f)) for f in (index.search(asked, variant, 7), R.bm25(frame, asked, variant, 7)))
        assert got == want and got
    only = spark.createDataFrame([("d",)], "paper_id string")
    assert rows_of(index.search(asked, "fts", 3, only)) == rows_of(R.bm25(frame, asked, "fts", 3, only))
    assert rows_of(index.compact(str(tmp_path / "iy")).search(asked, "fts", 7)) == rows_of(index.search(asked, "fts", 7))


def test_stemmed_search(spark, tmp_path):
    frame = chunk_frame(spark, [(1, "p", "All dependencies are résumé items"), (2, "p", "it depends"), (3, "q", "nothing here")])
    index = P.Index(spark, str(tmp_path / "ix")).build(frame)
    ask = spark.createDataFrame([(1, "dependencies"), (2, "depend"), (3, "RESUME")], "query_id long, query string")
    assert {(r["query_id"], r["chunk_id"]) for r in index.search(ask).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)}


def test_search_reads_asked_terms_only(spark, tmp_path, asked):
    index = P.Index(spark, str(tmp_path / "ix")).build(chunk_frame(spark, corpus(4, 0, ["a"], 50)), "plain", shards=2)
    plan = index.search(asked.limit(1))._jdf.queryExecution().toString()
    assert "PushedFilters: [Or" in plan or "EqualTo(term" in plan
    assert "BatchScan" not in plan and plan.count("FileScan parquet") == plan.count("postings") or "docs" not in plan


def shard_of(rows: list[tuple[str, list[tuple[int, int, int]]]]) -> P.Shard:
    """A shard of blocks ``(term, [(id, count, size)])``."""
    table = {
        "term": [t for t, _ in rows], "gen": [0] * len(rows), "sign": [1] * len(rows), "n": [len(b) for _, b in rows], "most": [max(c for _, c, _ in b) for _, b in rows], "least": [min(s for *_, s in b) for _, b in rows],
        "ids": [[i for i, *_ in b] for _, b in rows], "counts": [[c for _, c, _ in b] for _, b in rows], "sizes": [[s for *_, s in b] for _, b in rows], "papers": [["p"] * len(b) for _, b in rows], "allowed": [None] * len(rows),
    }
    return P.Shard(pa.table(table, schema=pa.schema([("term", pa.string()), *((c, pa.int32()) for c in ("gen", "sign", "n", "most", "least")), ("ids", pa.list_(pa.int64())), *((c, pa.list_(pa.int32())) for c in ("counts", "sizes")), ("papers", pa.list_(pa.string())), ("allowed", pa.list_(pa.bool_()))])), 1.2, 0.75, 10.0)


def test_blocks_are_skipped_and_nothing_is_lost():
    rng = random.Random(3)
    lists = {"rare": [(i, 3, 5) for i in range(0, 2000, 97)], **{f"often{k}": [(i, rng.randrange(1, 4), rng.randrange(5, 20)) for i in range(2000) if rng.random() < 0.5] for k in range(4)}}
    shard = shard_of([(t, own[a : a + 64]) for t, own in sorted(lists.items()) for a in range(0, len(own), 64)])
    weights = [("rare", 9.0), *((f"often{k}", 0.3) for k in range(4))]
    want: dict[int, float] = {}
    for t, w in weights:
        for i, c, s in lists[t]:
            want[i] = want.get(i, 0.0) + w * c / (c + 1.2 * (0.25 + 0.75 * s / 10))
    best = sorted(want, key=lambda i: (-round(want[i], 9), i))[:5]
    ids, scores = shard.scores(weights, -np.inf, 5)
    found = sorted(zip(ids.tolist(), scores.tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:5]
    assert [i for i, _ in found] == best and all(abs(s - want[i]) < 1e-6 for i, s in found)
    assert sum(p.opened for p in shard.terms.values()) < sum(len(p.blocks) for p in shard.terms.values())


# --- fan-out ----------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def little(spark):
    rows = [(i, f"p{i % 3}", "References" if i % 7 == 0 else "Method", "figure" if i % 4 == 0 else "text", f"graph {WORDS[i % 5]} text {WORDS[i % 9]}") for i in range(40)]
    return spark.createDataFrame(rows, "chunk_id long, paper_id string, section string, modality string, text string")


def test_rewrites(spark):
    ask = spark.createDataFrame(
        [(1, "What did the original RAG paper show in a figure?", None, ["about rag"], "rag"), (2, "plain", 'so: {"variants": ["Plain ", "other  words"], "keywords": "a b", "hyde": "an answer"}', None, None), (3, "broken", "{no json", [], "")],
        "query_id long, query string, reply string, hints array<string>, hint_terms string",
    )
    papers = spark.createDataFrame([("Retrieval Augmented Generation", 2020), ("Really Annotated Graphs", 2024), (None, 1)], "title string, year int")
    got = {r["query_id"]: r for r in fanout.rewrites(ask, papers).collect()}
    assert got[1]["dense_queries"] == ["What did the original RAG paper show in a figure?", "Retrieval Augmented Generation", "RAG original paper Retrieval Augmented Generation", "about rag"]
    assert got[1]["bm25_query"].endswith("figure? rag") and got[1]["modalities"] == ["figure"]
    assert got[2]["dense_queries"] == ["plain", "other words", "an answer"] and got[2]["bm25_query"] == "a b"
    assert got[3]["dense_queries"] == ["broken"] and got[3]["bm25_query"] == "broken"


def test_specs_are_numbered_in_order(spark):
    one = spark.createDataFrame([(5, "q", ["a", "b"], "", ["figure", "table"])], "query_id long, query string, dense_queries array<string>, bm25_query string, modalities array<string>")
    got = fanout.specs(one).orderBy("spec_id").collect()
    assert [(r["variant"], r["modality"]) for r in got] == [(v, m) for v in (0, 1) for m in (None, "figure", "table")] and [r["sparse_query"] for r in got] == ["a"] * 3 + ["b"] * 3


def test_a_leg_may_fail(spark, little):
    asked = spark.createDataFrame([(1, "graph w1", ["graph w1", "w2 text"], "", ["figure"])], "query_id long, query string, dense_queries array<string>, bm25_query string, modalities array<string>")
    dense = lambda a: R.dense(fanout.models.embed(little, "chunk_id", "text").join(little.select("chunk_id", "modality"), "chunk_id"), fanout.models.embed(a, "spec_id", "query").join(a.select("spec_id", "modality"), "spec_id").withColumnRenamed("spec_id", "query_id"), 20, "modality")
    sparse = lambda a: R.bm25(little, a, "fts", 20)

    def broken(_):
        raise ConnectionError("no server")

    both = fanout.retrieve(asked, little, dense, sparse, fanout.Round(top_k=6), fanout.models.overlap).collect()
    assert [r["position"] for r in sorted(both, key=lambda r: r["position"])] == list(range(6)) and len({r["chunk_id"] for r in both}) == 6
    assert all(r["score_rerank"] == r["score_rerank_raw"] and r["reference_penalized"] == (r["section"] == "References") for r in both)
    only = fanout.search(fanout.specs(asked), little, dense, broken, fanout.Round(top_k=6)).collect()
    assert only and all(r["score_bm25"] is None for r in only)
    kinds = {r["chunk_id"]: r["modality"] for r in little.collect()}
    for rows in (only, fanout.search(fanout.specs(asked), little, broken, sparse, fanout.Round(top_k=6)).collect()):
        assert {kinds[r["chunk_id"]] for r in rows if r["spec_id"] % fanout.MODALITIES} == {"figure"}
    with pytest.raises(RuntimeError, match="both"):
        fanout.search(fanout.specs(asked), little, broken, broken)


def test_a_failure_is_no_result(spark, little, monkeypatch):
    asked = spark.createDataFrame([(1, "graph w1", ["graph w1"], "", [])], "query_id long, query string, dense_queries array<string>, bm25_query string, modalities array<string>")
    dense = lambda a: R.dense(fanout.models.embed(little, "chunk_id", "text").join(little.select("chunk_id", "modality"), "chunk_id"), fanout.models.embed(a, "spec_id", "query").join(a.select("spec_id", "modality"), "spec_id").withColumnRenamed("spec_id", "query_id"), 20, "modality")
    torn = little.withColumn("text", F.raise_error(F.lit("torn file")).cast("string"))
    # a fault in a leg's tasks is raised, whoever calls
    for call in (lambda sparse: fanout.search(fanout.specs(asked), little, dense, sparse), lambda sparse: fanout.retrieve(asked, little, dense, sparse)):
        with pytest.raises(Exception, match="torn file"):
            call(lambda a: R.bm25(torn, a, "fts", 20)).collect()

    # a leg that cannot be reached is one too, unless the caller lets it go; then its rows say so
    def away(*_, **__):
        raise ConnectionError("no server")

    with pytest.raises(ConnectionError, match="no server"):
        fanout.retrieve(asked, little, dense, away).collect()
    assert {r["lost_leg"] for r in fanout.retrieve(asked, little, dense, away, unavailable=fanout.UNAVAILABLE).collect()} == {"sparse"}
    assert {r["lost_leg"] for r in fanout.retrieve(asked, little, dense, lambda a: R.bm25(little, a, "fts", 20)).collect()} == {None}
    from corvine.plans import retrieval

    monkeypatch.setattr(retrieval.R, "bm25", away)
    with pytest.raises(ConnectionError, match="no server"):
        retrieval.fanout_round(spark, "/root/testdata/sf0.001").collect()


# --- ingest -----------------------------------------------------------------------------------------------------------------------

PAPER = b"# Abstract\n\nWe study dependencies of graphs.\n\n## Introduction\n\nSome words here. ![a plot](img/x.png)\n\n| a | b |\n|-|-|\n| 1 | 2 |\n\n# References\n\n[1] Someone.\n"
FETCHED = "paper_id string, title string, doi string, content binary, layout string"
LAYOUT = '[{"type":"table","img_path":"images/x.png","page_idx":2,"table_caption":["Cap"]},{"type":"text"}]'


def parse(raw: bytes) -> str:
    if raw.startswith(b"bad"):
        raise RuntimeError("broken file")
    return raw.decode()


def shy_encoder():
    plain = N.models.hashing_encoder(16)

    def encode(texts):
        if any("unspeakable" in t for t in texts):
            raise ValueError("cannot encode")
        return plain(texts)

    return encode


@pytest.fixture(scope="module")
def into(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("ingest")
    return N.Ingest(Versions(spark, f"{folder}/store"), P.Index(spark, f"{folder}/index"), primary=parse, encoder=shy_encoder)


def reports(frame) -> dict:
    return {r["paper_id"]: r for r in frame.collect()}


def test_ingest_isolates_repeats_and_replaces(spark, into):
    rows = [("p1", "A Graph Study", "10.1/a", PAPER, LAYOUT), ("p2", "Other", "10.1/b", b"bad", None), ("p3", "A graph study!", None, PAPER, None), ("p4", "Empty", None, b" <!-- page 1 --> ", None), ("p1", "again", None, b"x", None), ("p5", "Fifth", None, b"Hello depend world.", None)]
    batch = spark.createDataFrame(rows, FETCHED).coalesce(1)
    first = reports(into.run(batch))
    assert {p: (r["status"], r["reason"], r["merged_into"]) for p, r in first.items()} == {"p1": ("done", None, None), "p2": ("failed", None, None), "p3": ("skipped", "dedup", "p1"), "p4": ("failed", None, None), "p5": ("done", None, None)}
    assert first["p1"]["chunks"] == first["p1"]["vector_updates"] == 6 and "broken file" in first["p2"]["error"]
    points = rows_of(into.points().select("point_id", "payload_fingerprint", F.hash("vector")))
    table = [r for r in into.points().collect() if r["page"] == 3]
    assert len(table) == 1 and table[0]["modality"] == "table" and table[0]["text"].startswith("Table: a plot Cap\nContext: ")
    assert {(r["paper_id"], r["step"], r["status"]) for r in into.steps().collect() if r["paper_id"] in ("p2", "p5")} == {("p2", "parse", "error"), *(("p5", s, "ok") for s in ("parse", "chunk", "embed", "index"))}
    assert {r["stage"] for r in into.runs().collect()} >= {"fetch", "decide", "build", "chunk", "plan", "embed"}
    # once more: nothing changes but that what failed is tried again
    again = reports(into.run(batch))
    assert {p: r["reason"] or r["status"] for p, r in again.items()} == {"p1": "done", "p2": "failed", "p3": "dedup", "p4": "failed", "p5": "done"}
    assert rows_of(into.points().select("point_id", "payload_fingerprint", F.hash("vector"))) == points and into.jobs().count() == 2
    # forced: a change of one paper, one that cannot be encoded keeps what it had, one that can be read now
    changed = [("p1", "A Graph Study", None, PAPER.replace(b"Some words", b"Other words"), LAYOUT), ("p5", "Fifth", None, b"Hello unspeakable world.", None), ("p2", "Other", None, b"good now", None)]
    forced = reports(into.run(spark.createDataFrame(changed, FETCHED), force=True))
    assert {p: r["status"] for p, r in forced.items()} == {"p1": "done", "p5": "failed", "p2": "done"} and "cannot encode" in forced["p5"]["error"]
    assert forced["p1"]["vector_updates"] + forced["p1"]["payload_updates"] + forced["p1"]["unchanged"] == 6 and forced["p1"]["unchanged"] >= 1 and forced["p1"]["deleted"] == 0
    papers = {r["paper_id"]: r for r in into.papers().collect()}
    assert papers["p1"]["doi"] == "10.1/a" and papers["p5"]["status"] == "failed" and papers["p2"]["status"] == "done"
    assert [r["text"] for r in into.points().collect() if r["paper_id"] == "p5" and r["modality"] == "text"] == ["Hello depend world."]
    assert into.index.chunks().count() == into.points().count() == 10 and into.jobs().count() == 4
    hits = into.index.search(spark.createDataFrame([(1, "other words"), (2, "depend")], "query_id long, query string")).collect()
    assert {(r["query_id"], r["paper_id"]) for r in hits} >= {(1, "p1"), (2, "p1"), (2, "p5")}


def test_index_heals_after_a_failure(spark, tmp_path):
    class Broken(P.Index):
        def sync(self, *args, **more):
            raise OSError("disk full")

    store = Versions(spark, str(tmp_path / "store"))
    into = N.Ingest(store, Broken(spark, str(tmp_path / "index")), primary=parse)
    rows = spark.createDataFrame([("a", "A", None, b"first words", None)], FETCHED)
    assert reports(into.run(rows))["a"]["status"] == "done"
    sound = N.Ingest(store, P.Index(spark, str(tmp_path / "index")), primary=parse)
    assert sound.index.chunks().count() == 0
    sound.follow()
    assert sound.index.chunks().count() == 2


def test_texts_are_on_disk_once_a_step(spark, tmp_path, monkeypatch):
    """What is staged holds no texts when a batch is done, and a batch that comes again is neither staged nor parsed; many ids meet texts by a shuffle, with the same report."""
    rows = [(f"p{i}", f"T{i // 2 if i < 6 else i}", None, b"bad" if i == 4 else b"words of a paper " * (i + 1), None) for i in range(12)]
    batch = spark.createDataFrame(rows, FETCHED)
    said = []
    for most in (N.MOST_KEYS, 0):
        monkeypatch.setattr(N, "MOST_KEYS", most)
        into = N.Ingest(Versions(spark, str(tmp_path / f"store-{most}")), P.Index(spark, str(tmp_path / f"index-{most}")), primary=parse, lenient=False)
        said.append([sorted((r["paper_id"], r["status"], r["reason"], r["merged_into"]) for r in into.run(batch).collect()) for _ in (1, 2)])
        for stage in (tmp_path / f"store-{most}" / "staging").iterdir():
            for gen in stage.iterdir():
                left = spark.read.parquet(str(gen))
                assert not {"markdown", "content", "text", "context_text", "pieces"} & set(left.columns) or left.isEmpty(), gen
        assert into.index.chunks().count() == into.points().count() == 16
    assert said[0] == said[1] and [r[1:] for r in said[0][0] if r[0] == "p1"] == [("skipped", "dedup", "p0")]

    class Broken(P.Index):
        def sync(self, *args, **more):
            raise OSError("disk full")

    with pytest.raises(OSError, match="disk full"):
        N.Ingest(Versions(spark, str(tmp_path / "s")), Broken(spark, str(tmp_path / "i")), primary=parse, lenient=False).run(batch)


def test_streamed_batches_are_not_done_twice(spark, tmp_path):
    into = N.Ingest(Versions(spark, str(tmp_path / "store")), primary=parse)
    rows = spark.createDataFrame([("a", "A", None, b"first words", None), ("b", "B", None, b"bad", None)], FETCHED)
    rows.write.parquet(str(tmp_path / "in"))
    for name in ("one", "two"):  # the second stream has lost its checkpoint, but not the name of its batches
        query = ingest_papers(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), into, str(tmp_path / name))
        query.awaitTermination()
        assert query.exception() is None
    assert into.store.last() == 0 and reports(into.reports()).keys() == {"a", "b"}


def one_by_one(rows: list[tuple]) -> dict[str, str]:
    taken: list[tuple] = []
    out = {}
    for row in sorted(rows, key=lambda r: r[1]):
        for k in (2, 3, 4):
            hit = next((t for t in taken if row[k] is not None and t[k] == row[k]), None)
            if hit:
                out[row[0]] = hit[0]
                break
        else:
            taken.append(row)
    return out


@pytest.mark.parametrize("seed", [1])
def test_batch_deduplication_is_as_if_one_by_one(spark, tmp_path, seed):
    rng = random.Random(seed)
    key = lambda: rng.choice([None, None, "x", "y", "z", "u", "v"])
    rows = [(f"p{i}", i, key(), key(), key()) for i in range(25)]
    frame = spark.createDataFrame(rows, "paper_id string, seq long, doi string, arxiv_id string, title_norm string")
    store = Versions(spark, str(tmp_path))
    got = N.merged_in_batch(frame, lambda name, part: store.staged(0, name, part))
    assert {r["paper_id"]: r["merged_into"] for r in got.collect()} == one_by_one(rows)


# --- vectors by cells -------------------------------------------------------------------------------------------------------------


def vectors(spark, seed: int, first: int, n: int, clusters: int):
    rng = np.random.default_rng(seed)
    middles = np.random.default_rng(0).normal(size=(clusters, 16))
    rows = [(first + i, f"p{i % 5}", (middles[i % clusters] + 0.3 * rng.normal(size=16)).astype(float).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, paper_id string, vector array<float>")


def test_cells_find_most_and_exactly_all(spark, tmp_path):
    from corvine.operators import cells

    points = vectors(spark, 1, 0, 900, 30).persist()
    extra = spark.createDataFrame([(5000, "p1", None), (5001, "p1", [0.0] * 16)], points.schema)
    index = cells.CellIndex(spark, str(tmp_path)).build(points.unionByName(extra))
    ask = vectors(spark, 2, 0, 40, 30).select(F.col("chunk_id").alias("query_id"), "vector")
    exact = R.dense(points.unionByName(extra), ask, 20)
    keys = ["query_id", "chunk_id", "rank_dense"]
    assert rows_of(index.search(ask, 20, 1, exact=True).select(keys)) == rows_of(exact.select(keys))
    assert index.probes() < len(index.centres()) and cells.recall(index.search(ask, 20), exact) >= 0.9
    # a paper is replaced, another one goes
    fresh = vectors(spark, 3, 9000, 50, 30).where("paper_id = 'p2'")
    index.sync(fresh, spark.createDataFrame([("p2",), ("p3",)], "paper_id string"))
    now = points.unionByName(extra).where("paper_id NOT IN ('p2', 'p3')").unionByName(fresh)
    assert rows_of(index.search(ask, 20, 2, exact=True).select(keys)) == rows_of(R.dense(now, ask, 20).select(keys))


def test_cells_recall_on_the_given_vectors(spark):
    """Vectors without clusters: recall at 20 is 0.9 or more all the same, by more probes."""
    from corvine.operators import cells
    from corvine.plans import retrieval

    d = "/root/testdata/sf0.01"
    asked = retrieval._asked(spark, d)
    assert cells.recall(retrieval._cells(spark, d).search(asked, 20), R.dense(retrieval._points(spark, d), asked, 20)) >= 0.9


# --- the answering chain on kept data -----------------------------------------------------------------------------------------------


def test_chain_reads_kept_index_and_vectors(spark, tmp_path, little):
    """The same rows as from the texts, without an encoder; and in variants and modalities."""
    from corvine.plans import answer

    ask = spark.createDataFrame([(1, "graph w1 figure"), (2, "text w3")], "query_id long, query string")
    index = P.Index(spark, str(tmp_path / "ix")).build(little, "plain", shards=2)
    vectors = fanout.models.embed(little, "chunk_id", "text").persist()
    plain = answer.retrieve(little, ask, answer.Settings(top_k=5))
    kept = answer.Settings(top_k=5, index=index, vectors=vectors)
    keys = ["query_id", "chunk_id", "position"]
    assert rows_of(answer.retrieve(little, ask, kept).select(keys)) == rows_of(plain.select(keys))
    wide = answer.Settings(top_k=5, index=index, vectors=vectors, rewrite=lambda q: fanout.rewrites(q.withColumn("hints", F.array(F.lit("w2 text")))))
    rows = answer.retrieve(little, ask, wide).collect()
    assert {r["query_id"] for r in rows} == {1, 2} and {r["variant"] for r in rows} <= {0, 1} and all(r["modality"] == "figure" for r in rows if r["asked_modality"])
    replies = answer.answer(little, ask, wide, reflect=lambda q, c: F.lit('{"sufficiency": "partial", "follow_up": "w4 text"}'), rounds=2).collect()
    assert len(replies) == 2 and all(r["citations"] or r["decision"] for r in replies)
