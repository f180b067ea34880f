"""Ingest of fetched papers into a store: de-duplication, parsing, chunks, differences to what is stored, vectors, index, jobs, records.

A batch is one commit of ``Versions``: papers, points with vectors, sections, steps, jobs and reports appear together or not at all.
Papers that are known under another id, or done already, are skipped; a paper whose parser, chunker or encoder fails gets a failed row and
keeps the points it had.  Only chunks whose content or model changed are encoded; a changed payload keeps its vector.  The index
follows after the commit; if that fails, the next batch brings it up to date.

Texts are on disk once a step: decisions are made on rows without them, only papers that are to be ingested are read again and parsed, points are
written once, with their vectors, where the commit has them, and the parsed papers are freed then.  So ``fetched`` is read several times and must give the same rows.

``fetched`` has ``paper_id, title`` and may have ``doi, arxiv_id, authors, year, venue, abstract, source, lang, layout``, and either ``markdown``
or ``content`` (bytes for the parsers).  Papers come in the order of ``seq`` where it is there, else of the rows; of rows with one id the first stays.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chunking, models
from ..functions import text as T
from ..sources import identifiers
from . import store as S
from .postings import Index
from .versions import Versions

log = logging.getLogger(__name__)

META = "paper_id string, title string, doi string, arxiv_id string, authors array<string>, year int, venue string, abstract string, source string, lang string"
PAPERS = f"{META}, title_norm string, status string, parsed_with string, quality string, error string"
PAYLOAD = "chunk_id string, paper_id string, section_id string, section string, section_idx int, modality string, page int, text string, context_text string, title string, char_start int, char_end int, raw_snippet string, asset string, metadata string"
POINTS = f"point_id string, {PAYLOAD}, content_id string, embedding_version string, payload_fingerprint string, vector array<float>"
SECTIONS = "section_id string, paper_id string, idx int, name string, level int"
STEPS = "paper_id string, step string, status string, error string, batch int"
JOBS = "paper_id string, fingerprint string, lang string, status string"
REPORTS = "paper_id string, status string, reason string, merged_into string, chunks int, vector_updates int, payload_updates int, unchanged int, deleted int, error string"
RUNS = "stage string, seconds double"
KEYS = ("doi", "arxiv_id", "title_norm")
TEXTS = ("markdown", "content")
#: Ids that go to all tasks, so that texts stay where they are; more meet texts by a shuffle.
MOST_KEYS = 1 << 18
#: The namespace of point ids and what the failure of an empty parse says.
POINTS_SPACE = "7e7c5b2b-3b7d-4f59-9f3e-82a4c8baf6d1"
NO_CHUNKS = "chunk: empty (parser produced no chunks)"

PIECE = "struct<idx:int,kind:string,ordinal:int,start:int,end:int,page:int,text:string,raw:string,asset:string,context:string,alt:string>"
BUILT = f"paper_id string, title string, lang string, parser string, step string, error string, sections array<struct<idx:int,name:string,level:int>>, pieces array<{PIECE}>"


def names(schema: str) -> list[str]:
    """The columns of a flat schema."""
    return [part.strip().split()[0] for part in schema.split(", ")]


def built(papers: DataFrame, primary: Callable[[bytes], str], fallback: Callable[[bytes], str] | None) -> DataFrame:
    """One row a paper (``BUILT``): its sections and pieces, or the step that failed and why.  ``papers`` has ``paper_id, title, markdown, content, lang``."""

    def text_of(markdown: str | None, content: bytes | None) -> tuple[str, str]:
        if markdown is not None:
            return markdown, "markdown"
        try:
            if (made := primary(content)) and chunking.PAGE_MARKER.sub("", made).strip():
                return made, "primary"
            problem = ValueError("no text")
        except Exception as why:
            problem = why
        if fallback is None:
            raise problem
        return fallback(content), "fallback"

    def pieces(text: str, lang: str | None) -> tuple[list[dict], list[dict]]:
        sections, out = [], []
        for idx, s in enumerate(chunking.sections(text, lang)):
            sections.append({"idx": idx, "name": s["name"], "level": s["level"]})
            body, base = text[s["start"] : s["end"]], s["start"]
            spans = [("text", a, b, body[a:b], None) for a, b in chunking.chunk_spans(body, lang)]
            spans += [(m["modality"], m["start"], m["end"], m["text"], m["asset"]) for m in chunking.media_spans(body, lang)]
            seen: dict[str, int] = {}
            for kind, a, b, words, asset in spans:
                ordinal = seen[kind] = seen.get(kind, -1) + 1
                raw = None if kind == "text" else body[a:b]
                near = None if kind == "text" else " ".join((body[max(0, a - chunking.REACH) : a] + " " + body[b : b + chunking.REACH]).split())
                alt = raw[2 : raw.index("]")].strip() if kind == "figure" else None
                out.append({"idx": idx, "kind": kind, "ordinal": ordinal, "start": base + a, "end": base + b, "page": chunking.page_of(text, base + a), "text": words, "raw": raw, "asset": asset, "context": near, "alt": alt})
        return sections, out

    def make(row: dict) -> dict:
        out = {c: row[c] for c in ("paper_id", "title", "lang")} | {"parser": None, "step": "parse", "error": None, "sections": None, "pieces": None}
        try:
            text, out["parser"] = text_of(row["markdown"], row["content"])
            out["step"] = "chunk"
            out["sections"], out["pieces"] = pieces((text or "").replace("\0", ""), row["lang"] if row["lang"] in ("zh", "en") else None)
            out["step"] = None
        except Exception as why:  # one paper's failure is its row, not the batch's
            out["error"] = f"{out['step']}: {why}"
        return out

    return chunking.mapped(papers, ["paper_id", "title", "markdown", "content", "lang"], BUILT, lambda row: [make(row)])


def card(meta: DataFrame) -> DataFrame:
    """A whole-paper chunk of each paper, in its language."""
    zh = F.col("lang") == "zh"
    alias = T.title_alias(F.col("title"))
    text = identifiers.paper_card(zh=zh, aliases=F.when(alias.isNotNull(), F.array(alias)), **{c: F.col(c) for c in ("title", "paper_id", "arxiv_id", "authors", "year", "venue", "doi", "abstract")})
    none = F.lit(None)
    return meta.select(
        F.left(F.sha1(F.concat("paper_id", F.lit("::paper-metadata"))), F.lit(20)).alias("chunk_id"), "paper_id", none.cast("string").alias("section_id"), F.lit("Paper Metadata").alias("section"), F.lit(-1).alias("section_idx"),
        F.lit("metadata").alias("modality"), none.cast("int").alias("page"), text.alias("text"), text.alias("context_text"), "title", none.cast("int").alias("char_start"), none.cast("int").alias("char_end"),
        none.cast("string").alias("raw_snippet"), none.cast("string").alias("asset"), F.to_json(F.struct(F.lit("paper_metadata").alias("element_type"), "source")).alias("metadata"),
    )


def chunk_rows(made: DataFrame, meta: DataFrame) -> DataFrame:
    """``PAYLOAD`` of built papers.  What the layout says of an asset goes before what the text says: page, caption, and whether it is a table.

    Only pieces with an asset meet the layout.
    """
    p = made.select("paper_id", "title", "lang", F.explode("pieces").alias("p"), "sections").select("paper_id", "title", "lang", "p.*", F.get("sections", F.col("p.idx"))["name"].alias("section"), F.get("sections", F.col("p.idx"))["level"].alias("level"))
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    block = "array<struct<type:string,img_path:string,page_idx:int,img_caption:array<string>,table_caption:array<string>>>"
    laid = meta.select("paper_id", F.explode(F.from_json("layout", block)).alias("b")).where("b.type IN ('image', 'table') AND b.img_path IS NOT NULL")
    words = F.array_join(F.filter(F.transform(F.coalesce(F.when(F.col("b.type") == "image", F.col("b.img_caption")).otherwise(F.col("b.table_caption")), F.array().cast("array<string>")), F.trim), lambda x: x != ""), " ")
    laid = laid.select("paper_id", base(F.col("b.img_path")).alias("asset_name"), F.col("b.type").alias("laid_kind"), (F.col("b.page_idx") + 1).alias("laid_page"), words.alias("laid_caption"))
    laid = laid.groupBy("paper_id", "asset_name").agg(F.max_by(F.struct("laid_kind", "laid_page", "laid_caption"), F.struct("laid_page", "laid_kind")).alias("laid")).select("paper_id", "asset_name", "laid.*")
    shown = p.where("asset is not null").withColumn("asset_name", base(F.col("asset"))).join(laid, ["paper_id", "asset_name"], "left")
    rows = p.where("asset is null").unionByName(shown, allowMissingColumns=True)
    zh = F.col("lang") == "zh"
    as_table = F.col("laid_kind") == "table"
    caption = F.when(F.col("laid_kind").isNotNull(), F.trim(F.concat_ws(" ", "alt", "laid_caption"))).otherwise(F.col("alt"))
    label = lambda i: F.when(zh, chunking.LABELS["zh"][i]).otherwise(chunking.LABELS["en"][i])
    around = F.concat(F.lit("\n"), label(3), F.lit(": "), F.coalesce("context", F.lit("")))
    text = F.when(as_table, F.concat(label(1), F.lit(": "), caption, around)).when(F.col("laid_kind").isNotNull() & (caption != ""), F.concat(label(0), F.lit(": "), caption, around, F.lit("\n"), label(4), F.lit(": "), "asset")).otherwise(F.col("text"))
    modality = F.when(as_table, "table").otherwise(F.col("kind"))
    visual = modality.isin("figure", "table")
    said = F.to_json(F.struct(F.col("level").alias("section_level"), F.col("ordinal").alias("chunk_ordinal"), F.when(F.col("kind") != "text", modality).alias("element_type"), F.when(visual, F.coalesce(caption, F.lit(""))).alias("caption"), F.when(visual, F.coalesce("context", F.lit(""))).alias("surrounding_context"), F.when(T.is_reference(F.col("section")), True).alias("is_references")))
    rows = rows.withColumns({"text": text, "said": said, "modality": modality})
    out = rows.select(
        T.chunk_id(F.col("paper_id"), F.col("idx"), F.col("kind"), F.col("ordinal")).alias("chunk_id"), "paper_id", T.section_id(F.col("paper_id"), F.col("idx")).alias("section_id"), "section", F.col("idx").alias("section_idx"), "modality",
        F.coalesce("laid_page", "page").alias("page"), "text", T.with_context(F.col("text"), F.col("title"), F.col("section"), zh).alias("context_text"), "title", F.col("start").alias("char_start"), F.col("end").alias("char_end"),
        F.col("raw").alias("raw_snippet"), "asset", F.col("said").alias("metadata"),
    )
    return out


def fingerprinted(rows: DataFrame, version: str) -> DataFrame:
    """``PAYLOAD`` with point ids and the three fingerprints."""
    point = T.uuid5(POINTS_SPACE, F.concat("paper_id", F.lit("\0"), "chunk_id"))
    whole = F.sha2(F.to_json(F.struct(*names(PAYLOAD)), {"ignoreNullFields": "false"}), 256)
    return rows.select(point.alias("point_id"), *names(PAYLOAD), F.sha2("context_text", 256).alias("content_id"), F.lit(version).alias("embedding_version"), whole.alias("payload_fingerprint"))


def encoded(rows: DataFrame, encoder: Callable[[], models.Encoder], batch: int = 32) -> DataFrame:
    """``POINTS`` and ``error`` of rows with ``POINTS`` and ``wanted``, where that is so with the vector of ``context_text``; where a batch fails its texts are tried one by one."""
    given = names(POINTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()

        def tried(texts: list[str]) -> list[tuple]:
            try:
                return [(v, None) for v in encode(texts)]
            except Exception as why:
                return [(None, f"embed: {why}")] if len(texts) == 1 else [x for t in texts for x in tried([t])]

        for part in chunking.pieces(batches):
            at = part.column("wanted").to_numpy(zero_copy_only=False).nonzero()[0]
            texts = part.column("context_text").take(pa.array(at)).to_pylist()
            vectors, errors = part.column("vector").to_pylist() if len(at) < part.num_rows else [None] * part.num_rows, [None] * part.num_rows
            got = [x for begin in range(0, len(texts), batch) for x in tried(texts[begin : begin + batch])]
            for i, (vector, error) in zip(at.tolist(), got, strict=True):
                vectors[i], errors[i] = vector, error
            same = [part.column(c) for c in given if c != "vector"]
            yield pa.RecordBatch.from_arrays([*same, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], [*given, "error"])

    return rows.select(*given, "wanted").mapInArrow(run, f"{POINTS}, error string")


def merged_in_batch(rows: DataFrame, keep: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
    """``paper_id, merged_into`` of papers that share a key with an earlier paper of the batch which is itself taken; ``rows`` has ``paper_id, seq`` and ``KEYS``.

    As if papers came one by one: a paper that is merged hides no later one.  Only papers that share a key take part; each round
    settles at least the first open one, and ``keep`` writes its rows down, which cuts the lineage.
    """
    shared = None
    for key in KEYS:
        twice = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
        own = rows.join(twice, key, "left_semi").select("paper_id")
        shared = own if shared is None else shared.unionByName(own)
    state = rows.select("paper_id", "seq", *KEYS).join(shared.distinct(), "paper_id", "left_semi")
    state = keep("merge-0", state.select("*", F.lit("open").alias("state"), F.lit(None).cast("string").alias("merged_into")))
    turn = 0
    while not state.where("state = 'open'").isEmpty():
        open_, leads, found, waits = F.col("state") == "open", F.lit(True), F.lit(None).cast("string"), F.lit(False)
        out = state
        for key in KEYS:  # the first row of a key that is not merged decides, once it is taken; a later key counts where no earlier one does
            live = state.where(F.col(key).isNotNull() & (F.col("state") != "merged"))
            out = out.join(live.groupBy(key).agg(F.min(F.struct("seq", "state", "paper_id")).alias(f"first_{key}")), key, "left")
            earlier = F.coalesce(F.col(f"first_{key}.seq") < F.col("seq"), F.lit(False))
            found = F.when(found.isNotNull() | waits, found).when(earlier & (F.col(f"first_{key}.state") == "taken"), F.col(f"first_{key}.paper_id"))
            waits = waits | (found.isNull() & earlier)
            leads = leads & ~earlier
        turn += 1
        state_ = F.when(~open_, F.col("state")).when(found.isNotNull(), "merged").when(leads, "taken").otherwise("open")
        state = keep(f"merge-{turn}", out.select("paper_id", "seq", *KEYS, state_.alias("state"), F.coalesce("merged_into", F.when(open_, found)).alias("merged_into")))
    return state.where("state = 'merged'").select("paper_id", "merged_into")


@dataclass
class Ingest:
    """A store, its hooks, and the index that follows it."""

    store: Versions
    index: Index | None = None
    primary: Callable[[bytes], str] = lambda raw: raw.decode()
    fallback: Callable[[bytes], str] | None = None
    encoder: Callable[[], models.Encoder] = models.hashing_encoder
    embedding_version: str = "hashing:v1"
    lenient: bool = True  # a failure of the index is logged and left to the next call, else it is raised
    seconds: dict[str, float] = field(default_factory=dict)

    def papers(self) -> DataFrame:
        return self.store.table("papers", PAPERS)

    def points(self, after: int = -1) -> DataFrame:
        return self.store.table("points", POINTS, after)

    def sections(self) -> DataFrame:
        return self.store.table("sections", SECTIONS)

    def steps(self) -> DataFrame:
        return self.store.all("steps", STEPS)

    def jobs(self) -> DataFrame:
        return self.store.all("jobs", JOBS)

    def reports(self, gen: int | None = None) -> DataFrame:
        rows = self.store.all("reports", REPORTS)
        return rows if gen is None else rows.where(F.col("gen") == gen).drop("gen")

    def runs(self) -> DataFrame:
        """Seconds of each stage of each run; a stage ends when its rows are written."""
        return self.store.all("runs", RUNS)

    def _timed(self, stage: str, gen: int, rows: DataFrame) -> DataFrame:
        began = time.perf_counter()
        out = self.store.staged(gen, stage, rows)
        self.seconds[stage] = round(time.perf_counter() - began, 3)
        return out

    def decided(self, batch: DataFrame, force: bool, gen: int) -> DataFrame:
        """``paper_id, reason, merged_into``: dedup, done, or null where the paper is to be ingested."""
        known = self.papers()
        if force:
            return batch.select("paper_id", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("merged_into"))
        found = S.first_match(batch.select("paper_id", *KEYS), known, "paper_id", KEYS)
        other = found.where("match_id <> paper_id").select("paper_id", F.col("match_id").alias("merged_into"))
        rows = batch.select("paper_id", "seq", *KEYS).join(other, "paper_id", "left_anti")
        done = known.where("status = 'done'").select("paper_id")
        merged = other.unionByName(merged_in_batch(rows, lambda name, frame: self.store.staged(gen, name, frame)))
        out = batch.select("paper_id").join(merged, "paper_id", "left").join(done.withColumn("was_done", F.lit(True)), "paper_id", "left")
        reason = F.when(F.col("merged_into").isNotNull(), "dedup").when(F.col("was_done"), "done")
        return out.select("paper_id", reason.alias("reason"), "merged_into")

    def run(self, fetched: DataFrame, force: bool = False, label: str | None = None) -> DataFrame:
        """Ingests a batch and gives its report (``REPORTS``); a batch whose label was committed before gives its report again."""
        if label is not None and (before := self.store.found(label)) is not None:
            return self.reports(before)
        gen = self.store.last() + 1
        self.seconds = {}
        whole = _whole(fetched)
        batch = self._timed("fetch", gen, whole.drop(*TEXTS))
        decided = self._timed("decide", gen, self.decided(batch, force, gen))
        todo = batch.join(decided.where("reason is null"), "paper_id", "left_semi")
        texts = picked(whole.select("paper_id", "title", "lang", *TEXTS), decided)
        if fetched.rdd.getNumPartitions() < (cores := self.store.spark.sparkContext.defaultParallelism):
            texts = texts.repartition(cores)
        made = self._timed("build", gen, built(texts, self.primary, self.fallback))
        empty = F.when(F.col("error").isNull() & (F.coalesce(F.size("pieces"), F.lit(0)) <= 0), F.lit(NO_CHUNKS))
        made = made.withColumn("error", F.coalesce("error", empty)).withColumn("step", F.when(F.col("error").isNotNull(), F.coalesce("step", F.lit("chunk"))))
        good = made.where("error is null")
        meta = todo.join(good.select("paper_id"), "paper_id", "left_semi")
        rows = fingerprinted(chunk_rows(good, meta).unionByName(card(meta)), self.embedding_version)
        fresh = self._timed("chunk", gen, rows.select("point_id", "paper_id", "chunk_id", "content_id", "embedding_version", "payload_fingerprint"))
        old = self.points().join(good.select("paper_id"), "paper_id", "left_semi")
        acts = S.incremental_diff(fresh, old, "point_id")
        who = fresh.select("point_id", "paper_id").unionByName(old.select("point_id", "paper_id")).distinct()
        plan = self._timed("plan", gen, acts.join(who, "point_id"))
        points = self._points(rows, old, plan, gen)
        bad = points.where("error is not null").groupBy("paper_id").agg(F.min("error").alias("embed_error"))
        result = made.join(bad, "paper_id", "left").select("paper_id", "parser", "sections", F.coalesce("error", "embed_error").alias("error"), F.when(F.col("error").isNotNull(), F.col("step")).when(F.col("embed_error").isNotNull(), "embed").alias("step"))
        result = self._timed("result", gen, result)
        self.store.used_up(gen, "build")
        fine = result.where("error is null").select("paper_id")
        if not result.where("step = 'embed'").isEmpty():  # papers that could not be encoded keep the points they had
            self.store.write(gen, "points", self.store.staged(gen, "points", points.join(fine, "paper_id", "left_semi")))
            self.store.used_up(gen, "points")
        counts = plan.join(fine, "paper_id", "left_semi").groupBy("paper_id").agg(*[F.sum((F.col("action") == a).cast("int")).cast("int").alias(n) for a, n in (("vector", "vector_updates"), ("payload", "payload_updates"), ("skip", "unchanged"), ("delete", "deleted"))])
        report = self._report(decided, result, counts)
        papers = self._papers(todo, result)
        log_rows = self._steps(result, gen)
        jobs = self._jobs(fresh.join(fine, "paper_id", "left_semi"), todo)
        sections = result.where("error is null").select("paper_id", F.explode("sections").alias("s"))
        sections = sections.select(T.section_id(F.col("paper_id"), F.col("s.idx")).alias("section_id"), "paper_id", "s.idx", "s.name", "s.level")
        began = time.perf_counter()
        report = self.store.staged(gen, "report", report)
        spent = self.store.spark.createDataFrame(list(self.seconds.items()), RUNS)
        nobody = fine.limit(0)
        self.store.commit(gen, {"papers": (papers, todo), "points": (None, fine), "sections": (sections, fine), "steps": (log_rows, nobody), "jobs": (jobs, nobody), "reports": (report, nobody), "runs": (spent, nobody)}, label)
        self.seconds["commit"] = round(time.perf_counter() - began, 3)
        for stage in ("chunk", "plan"):
            self.store.used_up(gen, stage)
        self.follow()
        return self.reports(gen)

    def _points(self, rows: DataFrame, old: DataFrame, plan: DataFrame, gen: int) -> DataFrame:
        """Writes the points where the commit will have them, with ``error`` where there is no vector; those whose content is what it was keep theirs."""
        if old.select("point_id").isEmpty():
            rows = rows.withColumns({"vector": F.lit(None).cast("array<float>"), "wanted": F.lit(True)})
        else:
            same = plan.where("action IN ('payload', 'skip')").select("point_id")
            kept = old.select("point_id", "vector", F.lit(False).alias("wanted")).join(same, "point_id", "left_semi")
            rows = rows.join(kept, "point_id", "left").withColumn("wanted", F.coalesce("wanted", F.lit(True)))
        began = time.perf_counter()
        out = self.store.write(gen, "points", encoded(rows, self.encoder))
        self.seconds["embed"] = round(time.perf_counter() - began, 3)
        return out

    def follow(self) -> None:
        """Brings the index up to the store: all papers whose points changed after the generation it has seen.  If ``lenient``, a failure is logged and the next call heals it."""
        if self.index is None:
            return
        try:
            spoke = self.store.all("owners", "table_name string, paper_id string").where("table_name = 'points'")
            sparse = lambda after: self.points(after).select(chunk_key(F.col("chunk_id")).alias("chunk_id"), "paper_id", "text")
            if not self.index.exists():  # empty at first, but with shards for all points, whose number follows from them
                self.index.build(sparse(-1).limit(0), "porter", self.index.shards_for(sparse(-1)))
            behind = spoke.where(F.col("gen") > (mark := self.index.mark())).select("paper_id").distinct()
            if not behind.isEmpty():
                self.index.sync(sparse(mark), behind, self.store.last(), only=True)
        except Exception as why:
            if not self.lenient:
                raise
            log.warning("index sync failed: %s", why)

    def _report(self, decided: DataFrame, result: DataFrame, counts: DataFrame) -> DataFrame:
        rows = decided.join(result.select("paper_id", "error", F.lit(True).alias("tried")), "paper_id", "left").join(counts, "paper_id", "left")
        status = F.when(F.col("reason").isNotNull(), "skipped").when(F.col("error").isNotNull(), "failed").otherwise("done")
        reason = F.when(F.col("error") == NO_CHUNKS, "no_chunks").otherwise(F.col("reason"))
        n = (F.col("vector_updates") + F.col("payload_updates") + F.col("unchanged")).alias("chunks")
        return rows.select("paper_id", status.alias("status"), reason.alias("reason"), "merged_into", n, "vector_updates", "payload_updates", "unchanged", "deleted", "error")

    def _papers(self, todo: DataFrame, result: DataFrame) -> DataFrame:
        """Fields that come as null keep what is stored."""
        old = self.papers().join(todo.select("paper_id"), "paper_id", "left_semi")
        before = old.select("paper_id", *[F.col(c).alias(f"old_{c}") for c in names(META) if c != "paper_id"])
        rows = todo.join(result, "paper_id").join(before, "paper_id", "left")
        value = {c: F.coalesce(F.col(f"old_{c}"), F.col(c)) if c == "lang" else F.coalesce(F.col(c), F.col(f"old_{c}")) for c in names(META) if c != "paper_id"}
        heads = F.transform("sections", lambda s: F.lower(s["name"]))
        quality = F.when(F.col("error").isNull(), graded(heads, F.col("lang")))
        status = F.when(F.col("error").isNull(), "done").otherwise("failed")
        rows = rows.withColumns({"status": status, "quality": quality, "parsed_with": F.concat_ws("+", "parser", quality)})
        return rows.select("paper_id", *[v.alias(c) for c, v in value.items()], "title_norm", "status", "parsed_with", "quality", "error")

    def _steps(self, result: DataFrame, gen: int) -> DataFrame:
        """One row a step that a paper reached; the one that failed says why."""
        order = F.array(*map(F.lit, ("parse", "chunk", "embed", "index")))
        reached = F.when(F.col("step").isNull(), order).otherwise(F.slice(order, 1, F.array_position(order, F.col("step"))))
        rows = result.select("paper_id", "error", F.col("step").alias("failed"), F.explode(reached).alias("step"))
        wrong = F.col("failed") == F.col("step")
        return rows.select("paper_id", "step", F.when(wrong, "error").otherwise("ok").alias("status"), F.when(wrong, F.col("error")).alias("error"), F.lit(gen).alias("batch"))

    def _jobs(self, fresh: DataFrame, todo: DataFrame) -> DataFrame:
        """A pending job a paper and content; one that was there before is not made again."""
        made = fresh.groupBy("paper_id").agg(S.fingerprint(F.col("chunk_id"), F.col("content_id")).alias("fingerprint")).join(todo.select("paper_id", "lang"), "paper_id")
        return made.join(self.jobs().select("paper_id", "fingerprint"), ["paper_id", "fingerprint"], "left_anti").select("paper_id", "fingerprint", "lang", F.lit("pending").alias("status"))


def graded(heads: Column, lang: Column) -> Column:
    """How complete a paper's sections are, by the words of their names in its language, of both where it is not known."""

    def has(area: str) -> Column:
        own = lambda language: F.exists(heads, lambda h: T.any_of(h, chunking.AREAS[language][area]))
        return F.when(lang == "en", own("en")).when(lang == "zh", own("zh")).otherwise(own("en") | own("zh"))

    i, m, e, c = (has(a) for a in ("intro", "method", "experiment", "conclusion"))
    return F.when(i & m & e & c, "complete").when(i & m & (e | c), "partial").when(i | m, "minimal").otherwise("broken")


def chunk_key(chunk_id: Column) -> Column:
    """The first 60 bits of a chunk id as a number, for the index."""
    return F.conv(F.left(chunk_id, F.lit(15)), 16, 10).cast("long")


def picked(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of papers without a ``reason``.  Of the two lists of ids, one that has at most ``MOST_KEYS`` goes to all tasks, so that no texts are shuffled."""
    todo, others = (decided.where(f"reason {x}").select("paper_id") for x in ("is null", "is not null"))
    if others.count() <= MOST_KEYS:
        return rows.join(F.broadcast(others), "paper_id", "left_anti")
    return rows.join(F.broadcast(todo) if todo.count() <= MOST_KEYS else todo, "paper_id", "left_semi")


def _whole(fetched: DataFrame) -> DataFrame:
    """All columns that may come, the first row of each id, and the order in which papers came.

    Only the numbers of rows are compared; where no id comes twice nothing is, and no file moves for it.
    """
    kinds = dict(zip(names(META), [p.strip().split(" ", 1)[1] for p in META.split(", ")], strict=True)) | {"layout": "string", "markdown": "string", "content": "binary"}
    nth = F.monotonically_increasing_id()
    rows = fetched.select(*[(F.col(c) if c in fetched.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()], (F.col("seq").cast("long") if "seq" in fetched.columns else nth).alias("seq"), nth.alias("nth"))
    rows = rows.where("paper_id is not null").withColumn("title_norm", F.when(T.title_norm(F.col("title")) != "", T.title_norm(F.col("title"))))
    place = F.struct("seq", "nth")
    several = rows.groupBy("paper_id").agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1")
    if several.isEmpty():
        return rows.drop("nth")
    late = rows.select("paper_id", "nth", place.alias("place")).join(several, "paper_id").where(F.col("place") != F.col("first")).select("nth")
    return rows.join(F.broadcast(late) if late.count() <= MOST_KEYS else late, "nth", "left_anti").drop("nth")


def summary(report: DataFrame) -> DataFrame:
    """One row ``done, skipped, failed, total``."""
    return report.agg(*[F.sum((F.col("status") == s).cast("int")).alias(s) for s in ("done", "skipped", "failed")], F.count("*").alias("total"))
