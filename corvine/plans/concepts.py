"""Queries of the concept rules, projections and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import concepts as C
from ..operators import context as K
from ..tables import CHUNK_SQL, chunks, load
from .registry import registry

QUERIES, SQL, query = registry()


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]', '', 'g') AS norm, CASE WHEN regexp_matches(p_name, '[A-Za-z]') THEN 'en' END AS language, length(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]', '', 'g')) <= 4 AS short FROM part")
def label_rules(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("p_name")
    return load(spark, d, "part").select("p_partkey", C.label_norm(name).alias("norm"), C.label_language(name).alias("language"), C.is_short(name).alias("short"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 AND length(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')) <= 4 THEN 'acronym' WHEN n_nationkey % 2 = 1 THEN 'translation' ELSE 'variant' END AS kind FROM nation")
def alias_kinds(spark: SparkSession, d: str) -> DataFrame:
    language = F.when(F.col("n_nationkey") % 2 == 0, "en").otherwise("zh")
    return load(spark, d, "nation").select("n_nationkey", C.alias_kind(F.col("n_name"), language, F.lit("Primary")).alias("kind"))


@query(f"""WITH {CHUNK_SQL} SELECT chunk_id, (CASE section WHEN 'Abstract' THEN 0 WHEN 'Introduction' THEN 1 WHEN 'Discussion' THEN 2 WHEN 'Conclusion' THEN 2 WHEN 'Method' THEN 3 WHEN 'Approach' THEN 3 ELSE 4 END)::INT AS bucket FROM chunk""")
def section_buckets(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", C.section_bucket(F.col("section")).alias("bucket"))


@query(f"""WITH RECURSIVE {CHUNK_SQL}, b AS (SELECT paper_id, chunk_id, length(text)::BIGINT AS cost, CASE section WHEN 'Abstract' THEN 0 WHEN 'Introduction' THEN 1 WHEN 'Discussion' THEN 2 WHEN 'Conclusion' THEN 2 WHEN 'Method' THEN 3 WHEN 'Approach' THEN 3 ELSE 4 END AS k FROM chunk WHERE modality = 'text' AND section <> 'References'),
o AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY k, chunk_id) AS n FROM b),
w AS (SELECT paper_id, n, chunk_id, cost AS used, true AS taken FROM o WHERE n = 1 UNION ALL
  SELECT o.paper_id, o.n, o.chunk_id, CASE WHEN w.used < 12000 AND w.used + o.cost <= 12000 THEN w.used + o.cost ELSE w.used END, w.used < 12000 AND w.used + o.cost <= 12000 FROM w JOIN o ON o.paper_id = w.paper_id AND o.n = w.n + 1)
SELECT paper_id, string_agg(chunk_id::VARCHAR, ',' ORDER BY n) AS taken FROM w WHERE taken GROUP BY paper_id""")
def budget_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks(spark, d).where("modality = 'text' and section <> 'References'")
    item = F.struct(C.section_bucket(F.col("section")).alias("k"), F.col("chunk_id").alias("id"), F.length("text").cast("long").alias("cost"))
    items = rows.groupBy("paper_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return items.select("paper_id", F.array_join(C.fill_budget(F.col("items"), 12000), ",").alias("taken"))


@query("""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(repeat(text || ' (chunk:' || conv_id || ') and [ chunk:x' || turn || ']. ', 4), '\\s*[\\[(]\\s*chunk:[^\\])]*[\\])]', '', 'g')) AS d FROM conversations)
SELECT conv_id, turn, CASE WHEN length(d) > 1200 THEN rtrim(left(d, 1197)) || '...' ELSE d END AS definition FROM t""")
def definition_clip(spark: SparkSession, d: str) -> DataFrame:
    text = F.repeat(F.concat("text", F.lit(" (chunk:"), "conv_id", F.lit(") and [ chunk:x"), "turn", F.lit("]. ")), F.lit(4))
    return load(spark, d, "conversations").select("conv_id", "turn", C.clip_definition(text).alias("definition"))


STOP = C.STOP_EN


@query(f"""WITH w AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{{2,}}'), lambda x: NOT list_contains({list(STOP)}, x)) AS w FROM benchmark)
SELECT item_id, array_to_string(w[1:6], ' ') || ';' || array_to_string(w[len(w) - 2:len(w)], ' ') AS phrases FROM w""")
def definition_phrases(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "benchmark").select("item_id", F.array_join(C.definition_phrases(F.col("text"), STOP), ";").alias("phrases"))


@query("""WITH old AS (SELECT l_suppkey AS entry_id, 'paper' AS kind, l_partkey::VARCHAR AS value FROM lineitem WHERE l_orderkey % 2 = 0),
ops AS (SELECT l_suppkey AS entry_id, CASE l_linenumber % 5 WHEN 0 THEN 'label' WHEN 1 THEN 'paper' WHEN 2 THEN 'evidence' WHEN 3 THEN 'problem' END AS kind, CASE WHEN l_orderkey % 7 = 1 THEN '' ELSE l_partkey::VARCHAR END AS value FROM lineitem WHERE l_orderkey % 2 = 1)
SELECT * FROM old UNION SELECT * FROM ops WHERE kind IS NOT NULL AND value <> '' AND (kind <> 'evidence' OR value::BIGINT % 2 = 0)""")
def patch_operations(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem")
    value = F.col("l_partkey").cast("string")
    old = lines.where("l_orderkey % 2 = 0").select(F.col("l_suppkey").alias("entry_id"), F.lit("paper").alias("kind"), value.alias("value"))
    op = F.get(F.array(*map(F.lit, ("add_label", "add_key_paper", "add_evidence", "add_open_problem", "unknown"))), F.col("l_linenumber") % 5)
    ops = lines.where("l_orderkey % 2 = 1").select(F.col("l_suppkey").alias("entry_id"), op.alias("op"), F.when(F.col("l_orderkey") % 7 == 1, " ").otherwise(value).alias("value"))
    return C.apply_patches(old, ops, load(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("value")))


@query("""WITH o AS (SELECT s_suppkey AS entry_id, s_name AS name, s_nationkey AS version FROM supplier), n AS (SELECT s_suppkey + 10 AS entry_id, 'new ' || s_name AS name FROM supplier WHERE s_suppkey % 2 = 0)
SELECT coalesce(o.entry_id, n.entry_id) AS entry_id, coalesce(n.name, o.name) AS name, CASE WHEN o.entry_id IS NULL THEN 1 WHEN n.entry_id IS NOT NULL THEN version + 1 ELSE version END AS version, n.entry_id IS NOT NULL AS dirty FROM o FULL JOIN n USING (entry_id)""")
def entry_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = load(spark, d, "supplier").select(F.col("s_suppkey").alias("entry_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("version"))
    new = old.where("entry_id % 2 = 0").select((F.col("entry_id") + 10).alias("entry_id"), F.concat(F.lit("new "), "name").alias("name"))
    return C.upsert_entries(old, new)


#: Questions from parts, so that each topic comes with all, some and none of its words.
ASKED = ("What is Recall@k", "the FactScore", "chunk size", "retrieval latency", "RAG-Sequence", "pre-retrieval", "reranking")
ASKED_TOO = ("of it?", "and Precision@k in retrieval", "in production with embedding", "of RAG and rerank", "or RAG-Token", "fact score of post-retrieval")


def _topic_sql() -> str:
    quoted = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
    hits = (" AND ".join("(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")" for words in groups) for groups, _ in C.TOPICS)
    found = " || ".join(f"CASE WHEN {hit} THEN {quoted(variants)} ELSE []::VARCHAR[] END" for hit, (_, variants) in zip(hits, C.TOPICS, strict=True))
    asked = f"lower({quoted(ASKED)}[doc_id % {len(ASKED)} + 1] || ' ' || {quoted(ASKED_TOO)}[doc_id % {len(ASKED_TOO)} + 1])"
    return f"WITH a AS (SELECT doc_id, {asked} AS q FROM documents) SELECT doc_id, array_to_string(({found})[1:5], ';') AS variants FROM a"


@query(_topic_sql())
def topical_rewrites(spark: SparkSession, d: str) -> DataFrame:
    part = lambda parts: F.get(F.array(*map(F.lit, parts)), (F.col("doc_id") % len(parts)).cast("int"))
    asked = F.concat_ws(" ", part(ASKED), part(ASKED_TOO))
    return load(spark, d, "documents").select("doc_id", F.array_join(C.topical_variants(asked), ";").alias("variants"))


@query("""SELECT event_id, '{"user":' || user_id || ',"steps":[{"kind":"' || event_type || '"},{"note":"' || event_id || '"}]}' AS kept FROM events""")
def secret_scrub(spark: SparkSession, d: str) -> DataFrame:
    """Keys that must not be stored are hidden in a list of objects and beside it."""
    template = '{"user":%d,"API_KEY":"%s","steps":[{"kind":"%s","user_password":"x"},{"note":"%d","nested-source-path":{"a":1}}],"prompt":["%s"]}'
    made = F.format_string(template, "user_id", "event_type", "event_type", "event_id", "event_type")
    return load(spark, d, "events").select("event_id", C.scrub_json(made).alias("kept"))


@query("""SELECT item_id, text || CASE WHEN item_id % 2 = 0 OR item_id % 3 = 0 OR item_id % 5 = 0 THEN chr(10) || chr(10) || array_to_string(list_filter([CASE WHEN item_id % 2 = 0 THEN 'wiki_context_fingerprint:c' || item_id END, CASE WHEN item_id % 3 = 0 THEN 'retrieval_top_k:7' END, CASE WHEN item_id % 5 = 0 THEN 'query_rewrite:false' END], lambda x: x IS NOT NULL), chr(10)) ELSE '' END AS key FROM benchmark""")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    made = C.cache_key(F.col("text"), F.when(i % 2 == 0, F.concat(F.lit("c"), i.cast("string"))).otherwise(""), F.when(i % 3 == 0, 7), i % 5 != 0)
    return load(spark, d, "benchmark").select("item_id", made.alias("key"))


@query("""SELECT event_type, user_id, '{event="' || event_type || '",user="' || user_id || '"}' AS labels, count(*) AS n FROM events GROUP BY ALL""")
def metric_exposition(spark: SparkSession, d: str) -> DataFrame:
    counts = load(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    labels = C.metric_labels(F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("event"), F.col("event_type")))
    return counts.select("event_type", "user_id", labels.alias("labels"), "n")


@query("""WITH h AS (SELECT source AS run_id, CASE doc_id % 2 WHEN 0 THEN 'dense' ELSE 'sparse' END AS stage, doc_id, row_number() OVER (PARTITION BY source, doc_id % 2 ORDER BY doc_id) - 1 AS rank, n_chars, left(text, 500) AS text FROM documents),
b AS (SELECT *, doc_id // 7 AS chunk_id FROM h) SELECT run_id, stage, chunk_id, max(n_chars) AS score FROM b GROUP BY ALL""")
def stage_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Stage snapshots are unfolded to ranked rows, and the best row of each chunk stays."""
    hit = F.struct("doc_id", F.floor(F.col("doc_id") / 7).alias("chunk_id"), F.col("n_chars").alias("score"), "text")
    of = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("doc_id") % 2 == k, hit))), lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["score"].alias("score"), x["text"].alias("text")))
    runs = load(spark, d, "documents").groupBy(F.col("source").alias("run_id")).agg(F.create_map(F.lit("dense"), of(0), F.lit("sparse"), of(1)).alias("stages"))
    return C.best_of_stage(C.stage_rows(runs)).select("run_id", "stage", "chunk_id", "score")


@query("SELECT doc_id AS query_id, CASE WHEN doc_id % 6 = 0 THEN 'not_applicable' WHEN doc_id % 5 = 0 OR doc_id % 4 = 0 THEN 'error' ELSE 'eligible' END AS status FROM labels")
def judge_eligibility(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    samples = load(spark, d, "labels").select(i.alias("query_id"), (i % 6 == 0).alias("expected_abstain"), F.when(i % 5 == 0, " ").otherwise("x").alias("response"), F.when(i % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("c"))).alias("contexts"), F.lit("r").alias("reference"))
    return C.eligibility(samples, True, True)


@query("SELECT n_regionkey AS entry_id, array_to_string(list_slice(list(n_name ORDER BY n_nationkey), 2, 6), ',') AS aliases FROM nation GROUP BY 1")
def context_projection(spark: SparkSession, d: str) -> DataFrame:
    own = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    entries = load(spark, d, "nation").groupBy(F.col("n_regionkey").alias("entry_id")).agg(own.alias("labels"))
    none = F.array().cast("array<string>")
    entries = entries.select("entry_id", F.get("labels", F.lit(0)).alias("name"), "labels", F.lit("d").alias("definition"), none.alias("key_papers"), none.alias("evidence_chunks"), F.lit(1).alias("version"))
    return C.context_row(entries).select("entry_id", F.array_join("aliases", ",").alias("aliases"))


@query("SELECT conv_id, string_agg(conv_id || ':' || turn, '|' ORDER BY conv_id || ':' || turn) AS fingerprint, count(*) AS versions FROM conversations GROUP BY conv_id")
def version_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    pair = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(pair)), "|").alias("fingerprint"), F.count("*").alias("versions"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
f AS (SELECT doc_id, n, sum(CASE WHEN length(line) < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l)
SELECT doc_id, count(*) AS kept FROM f WHERE coalesce(before, 0) = 0 GROUP BY doc_id""")
def tail_filter(spark: SparkSession, d: str) -> DataFrame:
    """Lines up to the first short one, which stands for a heading that closes the text."""
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    before = F.sum((F.length("line") < 60).cast("int")).over(Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    return lines.withColumn("before", F.coalesce(before, F.lit(0))).where("before = 0").groupBy("doc_id").agg(F.count("*").alias("kept"))


@query("SELECT CASE WHEN doc_id % 9 = 0 THEN 'failed' WHEN doc_id % 4 = 0 THEN 'skipped' ELSE 'done' END AS status, count(*) AS n FROM documents GROUP BY 1")
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("doc_id") % 9 == 0, "failed").when(F.col("doc_id") % 4 == 0, "skipped").otherwise("done")
    return load(spark, d, "documents").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT vec_id, greatest(0.0, least(1.0, CASE WHEN vec_id % 3 = 0 THEN 0.5 ELSE label / 4 END))::DOUBLE AS score, CASE vec_id % 3 WHEN 1 THEN 'partial' ELSE 'sufficient' END AS sufficiency FROM embeddings")
def reflection_sanitise(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.models import reflection

    said = F.when(F.col("vec_id") % 3 == 0, "no object").when(F.col("vec_id") % 3 == 1, F.concat(F.lit('x {"sufficiency": " PARTIAL", "score": "'), (F.col("label") / 4).cast("string"), F.lit('"} y'))).otherwise(F.concat(F.lit('{"sufficiency": "odd", "score": "'), (F.col("label") / 4).cast("string"), F.lit('"}')))
    rows = load(spark, d, "embeddings").select("vec_id", reflection(said).alias("r"))
    return rows.select("vec_id", F.col("r.score").alias("score"), F.col("r.sufficiency").alias("sufficiency"))


#: Concepts are suppliers, named by long words of the questions; every tenth is merged into the next one.  A question's hits are the lines of the orders with its number at the end.
_CONTEXT = r"""item AS (SELECT item_id AS q, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS norm FROM benchmark),
word AS (SELECT row_number() OVER (ORDER BY w) - 1 AS i, w, count(*) OVER () AS n FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]{5,}')) AS w FROM benchmark)),
entry AS (SELECT s_suppkey AS e, w AS name, CASE WHEN s_suppkey % 10 = 9 THEN s_suppkey + 1 END AS into_ FROM supplier JOIN word ON i = s_suppkey * 3 % n),
label AS (SELECT s_suppkey AS e, w AS label FROM supplier JOIN word ON i = s_suppkey * 7 % n WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, left(w, 2) FROM supplier JOIN word ON i = s_suppkey * 11 % n),
paper AS (SELECT DISTINCT l_suppkey AS e, l_orderkey % 400 AS p FROM lineitem WHERE l_linenumber = 1), proof AS (SELECT DISTINCT l_suppkey AS e, l_partkey AS c FROM lineitem),
hit AS (SELECT DISTINCT q, l_partkey AS c, l_orderkey % 400 AS p FROM item JOIN lineitem ON l_orderkey % 1000 = q),
near AS (SELECT q, ((q * 5 + k) % (SELECT count(*) FROM supplier)) + 1 AS e, k AS place FROM item, (SELECT unnest([0, 1, 2]) AS k))"""


def _context(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    bench, lines, suppliers = load(spark, d, "benchmark"), load(spark, d, "lineitem"), load(spark, d, "supplier")
    words = bench.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]{5,})"), F.lit(1))).alias("w")).distinct()
    words = words.select(F.array_sort(F.collect_set("w").over(Window.partitionBy())).alias("all")).limit(1)
    key = F.col("s_suppkey")
    named = suppliers.join(F.broadcast(words)).select(key.alias("entry_id"), *[F.get("all", (key * k % F.size("all")).cast("int")).alias(f"w{k}") for k in (3, 7, 11)])
    entries = named.select("entry_id", F.col("w3").alias("name_norm"), F.when(F.col("entry_id") % 10 == 9, F.col("entry_id") + 1).alias("merged_into"))
    labels = named.where("entry_id % 2 = 0").select("entry_id", F.col("w7").alias("label_norm")).unionByName(named.select("entry_id", F.left("w11", F.lit(2)).alias("label_norm")))
    questions = bench.select(F.col("item_id").alias("query_id"), F.regexp_replace(F.lower("text"), "[^a-z0-9]", "").alias("question_norm"))
    hits = lines.join(F.broadcast(questions.select("query_id")), F.col("l_orderkey") % 1000 == F.col("query_id")).select("query_id", F.col("l_partkey").alias("chunk_id"), (F.col("l_orderkey") % 400).alias("paper_id"))
    n = suppliers.agg(F.count("*").alias("n"))
    near = questions.join(F.broadcast(n)).select("query_id", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("place"), "n").select("query_id", ((F.col("query_id") * 5 + F.col("place")) % F.col("n") + 1).alias("entry_id"), "place")
    return {"questions": questions, "entries": entries, "labels": labels, "papers": lines.where("l_linenumber = 1").select(F.col("l_suppkey").alias("entry_id"), (F.col("l_orderkey") % 400).alias("paper_id")), "evidence": lines.select(F.col("l_suppkey").alias("entry_id"), F.col("l_partkey").alias("chunk_id")), "hits": hits, "near": near}


@query(f"""WITH {_CONTEXT},
lex AS (SELECT q, e, CASE WHEN contains(norm, name) THEN 100 WHEN EXISTS (SELECT 1 FROM label WHERE label.e = entry.e AND length(label) >= 3 AND contains(norm, label)) THEN 90 ELSE 0 END AS s FROM item, entry WHERE into_ IS NULL),
sh AS (SELECT q, e, 50 + least(count(*), 3) AS s FROM (SELECT DISTINCT q, p FROM hit WHERE c % 100 = 1) JOIN paper USING (p) JOIN entry USING (e) WHERE into_ IS NULL GROUP BY q, e),
sc AS (SELECT q, e, sum(s)::INT AS s FROM (FROM lex UNION ALL FROM sh) GROUP BY q, e HAVING sum(s) > 0),
al AS (FROM sc UNION ALL SELECT q, e, 25 FROM near JOIN entry USING (e) WHERE into_ IS NULL AND q NOT IN (SELECT q FROM sc) QUALIFY row_number() OVER (PARTITION BY q ORDER BY place) = 1)
SELECT q AS query_id, e AS entry_id, s AS score, (row_number() OVER (PARTITION BY q ORDER BY s DESC, e) - 1)::INT AS rank FROM al QUALIFY rank < 3""")
def question_context_rank(spark: SparkSession, d: str) -> DataFrame:
    c = _context(spark, d)
    scope = c["hits"].where("chunk_id % 100 = 1").select("query_id", "paper_id")
    return K.question_context(c["questions"], c["entries"], c["labels"], c["papers"], scope, c["near"])


@query(f"""WITH {_CONTEXT}, live AS (SELECT * FROM entry WHERE into_ IS NULL), asked AS (SELECT * FROM item WHERE q IN (SELECT q FROM hit)),
dr AS (SELECT q, e, count(*) AS n FROM (SELECT DISTINCT q, c FROM hit) JOIN proof USING (c) GROUP BY q, e), pp AS (SELECT q, e, count(*) AS n FROM (SELECT DISTINCT q, p FROM hit) JOIN paper USING (p) GROUP BY q, e),
sc AS (SELECT q, e, coalesce(dr.n, 0) AS dr, coalesce(pp.n, 0) AS pp, contains(norm, name) OR EXISTS (SELECT 1 FROM label WHERE label.e = live.e AND label <> '' AND contains(norm, label)) AS lb FROM asked CROSS JOIN live LEFT JOIN dr USING (q, e) LEFT JOIN pp USING (q, e)),
ti AS (SELECT q, e, (CASE WHEN dr > 0 THEN 300 WHEN pp > 0 THEN 200 ELSE 100 END + least(dr, 10) + least(pp, 5))::INT AS s FROM sc WHERE dr > 0 OR pp > 0 OR lb),
nr AS (SELECT q, coalesce(into_, e) AS e, min(place) AS place FROM near JOIN entry USING (e) WHERE q IN (SELECT q FROM asked) GROUP BY ALL),
fi AS (SELECT q, e, 25 AS s FROM nr ANTI JOIN ti USING (q, e) LEFT JOIN (SELECT q, count(*) AS have FROM ti GROUP BY q) USING (q) QUALIFY row_number() OVER (PARTITION BY q ORDER BY place, e) <= 3 - coalesce(have, 0)),
al AS (FROM ti UNION ALL FROM fi)
SELECT q AS query_id, e AS entry_id, s AS score, (row_number() OVER (PARTITION BY q ORDER BY s DESC, e) - 1)::INT AS rank FROM al QUALIFY rank < 3""")
def evidence_context_rank(spark: SparkSession, d: str) -> DataFrame:
    c = _context(spark, d)
    return K.evidence_context(c["questions"], c["hits"], c["entries"], c["labels"], c["papers"], c["evidence"], c["near"])


#: Suppliers as entries: every tenth is merged already; asked merges: into the next one, back along a redirect, into one that is not there, and two into one.
_MERGES = """e AS (SELECT s_suppkey AS id, s_nationkey AS version, CASE WHEN s_suppkey % 10 = 9 THEN s_suppkey + 1 END AS into_ FROM supplier),
a AS (SELECT id AS source, CASE WHEN id % 20 = 3 THEN id + 1 WHEN id % 20 = 10 THEN id - 1 WHEN id % 50 = 6 THEN -1 WHEN id % 20 IN (14, 15) THEN id - id % 20 + 16 END AS target FROM e WHERE id % 20 IN (3, 10, 14, 15) OR id % 50 = 6),
f AS (SELECT source, target, coalesce(e.into_, e.id) AS final FROM a LEFT JOIN e ON e.id = target),
o AS (SELECT source, target, CASE WHEN final IS NULL THEN 'missing' WHEN final = source THEN 'cycle' WHEN target % 20 = 16 THEN 'conflict' ELSE 'merged' END AS outcome, final FROM f),
edge AS (SELECT DISTINCT l_suppkey AS id, l_partkey AS part FROM lineitem)"""


def _merged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = F.col("s_suppkey")
    entries = load(spark, d, "supplier").select(n.alias("entry_id"), F.col("s_nationkey").alias("version"), F.when(n % 10 == 9, n + 1).alias("merged_into"), F.lit(False).alias("dirty"))
    e = F.col("entry_id")
    target = F.when(e % 20 == 3, e + 1).when(e % 20 == 10, e - 1).when(e % 50 == 6, F.lit(-1)).when((e % 20).isin(14, 15), e - e % 20 + 16)
    asked = entries.select(e.alias("source_id"), target.alias("target_id")).where("target_id is not null")
    edges = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("entry_id"), F.lit("evidence").alias("kind"), F.col("l_partkey").alias("value")).distinct()
    return C.merge(entries, edges, asked)


@query(f"""WITH {_MERGES} SELECT id AS entry_id, (version + CASE WHEN id IN (SELECT final FROM o WHERE outcome = 'merged') THEN 1 ELSE 0 END)::INT AS version, coalesce((SELECT any_value(final) FROM o WHERE source = id AND outcome = 'merged'), into_) AS merged_into,
  id IN (SELECT final FROM o WHERE outcome = 'merged') AS dirty, (SELECT any_value(outcome) FROM o WHERE source = id) AS outcome FROM e""")
def concept_merge(spark: SparkSession, d: str) -> DataFrame:
    entries, _, outcome = _merged(spark, d)
    return entries.join(outcome.select(F.col("source_id").alias("entry_id"), "outcome"), "entry_id", "left")


@query(f"""WITH {_MERGES}, x AS (FROM edge UNION SELECT final, part FROM edge JOIN o ON source = id WHERE outcome = 'merged') SELECT id AS entry_id, count(*) AS n_edges, sum(part)::BIGINT AS parts FROM x GROUP BY id""")
def concept_merge_edges(spark: SparkSession, d: str) -> DataFrame:
    _, edges, _ = _merged(spark, d)
    return edges.groupBy("entry_id").agg(F.count("*").alias("n_edges"), F.sum("value").alias("parts"))


@query("""WITH RECURSIVE p AS (SELECT o_custkey % 100 + 1 AS e, o_orderkey AS seq, o_orderdate AS made, CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE o_orderpriority END AS d FROM orders WHERE o_custkey % 100 < (SELECT count(*) FROM supplier)),
s AS (SELECT s_suppkey AS e, s_name AS d, CASE WHEN s_suppkey % 3 = 0 THEN TIMESTAMP '1995-01-01' END AS lock FROM supplier),
t AS (SELECT e, seq, made, trim(d) AS d, row_number() OVER (PARTITION BY e ORDER BY made, seq) AS n FROM p JOIN (SELECT e, lock FROM s) USING (e) WHERE trim(d) <> '' AND (lock IS NULL OR made >= lock)),
w(e, n, made, d) AS (SELECT e, n, made, d FROM t WHERE n = 1 UNION ALL (SELECT t.e, t.n, t.made, t.d FROM w JOIN t ON t.e = w.e AND t.n > w.n AND t.made >= w.made + INTERVAL 2400 HOUR QUALIFY row_number() OVER (PARTITION BY t.e ORDER BY t.n) = 1)),
l AS (SELECT e, max(n) AS n FROM w GROUP BY e)
SELECT s.e AS entry_id, coalesce(w.d, s.d) AS definition, coalesce(w.made + INTERVAL 2400 HOUR, lock) AS lock_until FROM s LEFT JOIN l ON l.e = s.e LEFT JOIN w ON w.e = l.e AND w.n = l.n""")
def definition_lock(spark: SparkSession, d: str) -> DataFrame:
    """Order priorities as proposals of definitions, each of which locks its concept for 100 days."""
    n = F.col("s_suppkey")
    entries = load(spark, d, "supplier").select(n.alias("entry_id"), F.col("s_name").alias("definition"), F.when(n % 3 == 0, F.lit("1995-01-01").cast("timestamp")).alias("lock_until"))
    orders = load(spark, d, "orders").select((F.col("o_custkey") % 100 + 1).alias("entry_id"), F.when(F.col("o_orderkey") % 9 == 0, " ").otherwise(F.col("o_orderpriority")).alias("definition"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderkey").alias("seq"))
    return C.apply_definitions(entries, orders, 2400)
