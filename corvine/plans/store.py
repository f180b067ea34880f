"""Queries of table maintenance and the concept store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index as I
from ..operators import retrieval as R
from ..operators import store as S
from ..tables import load
from .registry import registry

QUERIES, SQL, query = registry()


def _points(frame: DataFrame, twist: bool) -> DataFrame:
    """Point rows of documents; the older snapshot lacks, has more and differs by id."""
    text, version, payload = F.col("text"), F.lit("v2"), F.concat_ws("|", "source", "lang")
    if twist:
        text = F.when(F.col("doc_id") % 7 == 3, F.concat("text", F.lit("."))).otherwise(F.col("text"))
        version = F.when(F.col("doc_id") % 11 == 4, "v1").when(F.col("doc_id") % 13 == 5, F.lit(None)).otherwise("v2")
        payload = F.when(F.col("doc_id") % 5 == 2, F.lit("old")).otherwise(payload)
    return frame.select(F.col("doc_id").alias("point_id"), F.sha2(text, 256).alias("content_id"), version.cast("string").alias("embedding_version"), F.sha2(payload, 256).alias("payload_fingerprint"))


@query("""WITH n AS (SELECT doc_id AS point_id, sha256(text) AS c, 'v2' AS v, sha256(source || '|' || lang) AS p FROM documents WHERE doc_id % 17 <> 1),
o AS (SELECT doc_id AS point_id, sha256(CASE WHEN doc_id % 7 = 3 THEN text || '.' ELSE text END) AS c, CASE WHEN doc_id % 11 = 4 THEN 'v1' WHEN doc_id % 13 = 5 THEN NULL ELSE 'v2' END AS v,
  sha256(CASE WHEN doc_id % 5 = 2 THEN 'old' ELSE source || '|' || lang END) AS p FROM documents WHERE doc_id % 19 <> 1)
SELECT point_id, CASE WHEN n.c IS NULL THEN 'delete' WHEN o.c IS NULL OR o.v IS NULL OR n.c <> o.c OR n.v <> o.v THEN 'vector' WHEN n.p <> o.p THEN 'payload' ELSE 'skip' END AS action FROM n FULL JOIN o USING (point_id)""")
def incremental_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return S.incremental_diff(_points(docs.where("doc_id % 17 <> 1"), False), _points(docs.where("doc_id % 19 <> 1"), True))


@query("""WITH k AS (SELECT * FROM customer WHERE c_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey < 5))
SELECT c_custkey, c_nationkey, c_acctbal FROM k UNION ALL SELECT c_custkey, c_nationkey, c_acctbal + 1 FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey < 5""")
def snapshot_replace(spark: SparkSession, d: str) -> DataFrame:
    old = load(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    new = old.where("c_custkey % 2 = 0 AND c_nationkey < 5").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    return S.replace_snapshot(old, new, "c_nationkey")


@query("""WITH n AS (SELECT c_custkey + 100 AS c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal, coalesce(o.c_mktsegment, n.c_mktsegment) AS c_mktsegment FROM customer o FULL JOIN n ON o.c_custkey = n.c_custkey""")
def upsert_coalesce(spark: SparkSession, d: str) -> DataFrame:
    old = load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    new = old.select((F.col("c_custkey") + 100).alias("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment")
    return S.upsert(old, new, "c_custkey", insert_only=("c_mktsegment",))


@query("SELECT count(DISTINCT source) AS papers, count(*) AS chunks, count(*) FILTER (doc_id % 12 IN (0, 1)) AS visual_chunks, (SELECT count(*) FROM part) AS entries FROM documents")
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    counts = docs.agg(F.count_distinct("source").alias("papers"), F.count("*").alias("chunks"), F.count_if((F.col("doc_id") % 12).isin(0, 1)).alias("visual_chunks"))
    return counts.crossJoin(load(spark, d, "part").agg(F.count("*").alias("entries")))


@query("SELECT n_nationkey, n_name, count(c_custkey) AS n_chunks FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY ALL")
def papers_with_chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = load(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return load(spark, d, "nation").join(counts, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("n", F.lit(0).cast("long")).alias("n_chunks"))


@query("""WITH o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7))
SELECT 'customer' AS table_name, count(*) AS n FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (FROM o)""")
def cascade_delete_preview(spark: SparkSession, d: str) -> DataFrame:
    who = load(spark, d, "customer").where("c_nationkey = 7")
    orders = load(spark, d, "orders").join(who, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    lines = load(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return S.cascade_counts([("customer", who), ("orders", orders), ("lineitem", lines)])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    who = load(spark, d, "customer").where("c_nationkey = 7").select("c_custkey")
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    return orders.join(who, orders["o_custkey"] == who["c_custkey"], "left_anti")


@query("""WITH a AS (SELECT DISTINCT doc_id + 5 AS paper_id FROM labels), p AS (SELECT doc_id AS paper_id, CASE WHEN doc_id % 6 = 0 THEN 'parsed' ELSE 'done' END AS status, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'system' WHEN 2 THEN 'me' ELSE 'other' END AS user_id FROM documents)
SELECT a.paper_id, CASE WHEN p.paper_id IS NULL THEN 'missing' WHEN status <> 'done' THEN 'not_done' WHEN user_id = 'other' THEN 'forbidden' END AS problem FROM a LEFT JOIN p USING (paper_id)""")
def scope_validation(spark: SparkSession, d: str) -> DataFrame:
    asked = load(spark, d, "labels").select((F.col("doc_id") + 5).alias("paper_id"))
    user = F.when(F.col("doc_id") % 4 == 1, "system").when(F.col("doc_id") % 4 == 2, "me").when(F.col("doc_id") % 4 == 3, "other")
    papers = load(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), F.when(F.col("doc_id") % 6 == 0, "parsed").otherwise("done").alias("status"), user.alias("user_id"))
    return S.validate_scope(asked, papers, "me")


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS entry_id, CASE WHEN p_partkey % 50 = 49 THEN p_partkey - 3 WHEN p_partkey % 50 = 46 THEN p_partkey + 3 WHEN p_partkey % 25 <> 0 THEN p_partkey - 1 END AS merged_into FROM part),
r AS (SELECT entry_id, entry_id AS target_id, 0 AS hop FROM e UNION ALL SELECT r.entry_id, e.merged_into, hop + 1 FROM r JOIN e ON e.entry_id = r.target_id WHERE e.merged_into IS NOT NULL AND hop < 10)
SELECT entry_id, arg_max(target_id, hop) AS target_id FROM r GROUP BY entry_id""")
def redirect_closure(spark: SparkSession, d: str) -> DataFrame:
    """Chains of up to 24 entries, longer than may be followed, and rings of two."""
    key = F.col("p_partkey")
    into = F.when(key % 50 == 49, key - 3).when(key % 50 == 46, key + 3).when(key % 25 != 0, key - 1)
    return S.resolve_redirects(load(spark, d, "part").select(key.alias("entry_id"), into.alias("merged_into")))


CONCEPTS = "concept AS (SELECT p_partkey AS entry_id, p_name AS name, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS label, p_size AS size FROM part)"


def _concepts(spark: SparkSession, d: str) -> DataFrame:
    label = F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "")
    return load(spark, d, "part").select(F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("name"), label.alias("label"), F.col("p_size").alias("size"))


@query(f"WITH {CONCEPTS} SELECT label, count(*) AS entries, min(entry_id) AS first_entry FROM concept WHERE label IN (SELECT DISTINCT regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') FROM part WHERE p_size = 1) GROUP BY label")
def label_lookup(spark: SparkSession, d: str) -> DataFrame:
    concepts = _concepts(spark, d)
    asked = concepts.where("size = 1").select("label").distinct()
    return concepts.join(asked, "label", "left_semi").groupBy("label").agg(F.count("*").alias("entries"), F.min("entry_id").alias("first_entry"))


@query("""WITH c AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM benchmark) WHERE length(word) >= 6),
e AS (SELECT row_number() OVER (ORDER BY word) AS entry_id, word AS name FROM c),
q AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
s AS (SELECT doc_id, name, 100 AS score FROM (SELECT doc_id, unnest(w) AS name FROM q) JOIN e USING (name))
SELECT doc_id, name, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, name) - 1)::INT AS rank FROM s) WHERE rank < 3""")
def wiki_context_rank(spark: SparkSession, d: str) -> DataFrame:
    """Concepts are long words of the questions; a document's are those whose name it has as a word."""
    word = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))
    names = load(spark, d, "benchmark").select(F.explode(word("text")).alias("name")).where("length(name) >= 6").distinct()
    docs = load(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(word("text"))).alias("name"))
    return R.best(docs.join(names, "name").withColumn("score", F.lit(100)), ["doc_id"], [F.desc("score"), F.asc("name")], 3).select("doc_id", "name", "score", "rank")


@query("""WITH hit AS (SELECT l_orderkey AS q, l_partkey AS chunk, l_suppkey AS paper FROM lineitem WHERE l_orderkey % 40 = 0),
ev AS (SELECT l_suppkey AS entry, l_partkey AS chunk FROM lineitem WHERE l_orderkey % 40 <> 0 GROUP BY ALL), kp AS (SELECT s_suppkey AS entry, s_suppkey AS paper FROM supplier),
a AS (SELECT q, entry, count(DISTINCT chunk) AS direct, 0 AS papers FROM hit JOIN ev USING (chunk) GROUP BY ALL),
b AS (SELECT q, entry, 0 AS direct, count(DISTINCT paper) AS papers FROM hit JOIN kp USING (paper) GROUP BY ALL),
m AS (SELECT q, entry, max(direct) AS direct, max(papers) AS papers FROM (FROM a UNION ALL FROM b) GROUP BY ALL),
s AS (SELECT q, entry, (CASE WHEN direct > 0 THEN 300 ELSE 200 END + least(direct, 10) + least(papers, 5))::INT AS score FROM m)
SELECT q, entry, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY q ORDER BY score DESC, entry) - 1)::INT AS rank FROM s) WHERE rank < 3""")
def evidence_wiki_rank(spark: SparkSession, d: str) -> DataFrame:
    """Concepts (suppliers) by the evidence (parts) and papers they share with a question's hits."""
    lines = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("chunk"), F.col("l_suppkey").alias("paper"))
    hits = lines.where("q % 40 = 0")
    evidence = lines.where("q % 40 <> 0").select(F.col("paper").alias("entry"), "chunk").distinct()
    direct = hits.join(evidence, "chunk").groupBy("q", "entry").agg(F.count_distinct("chunk").alias("direct"), F.lit(0).cast("long").alias("papers"))
    shared = hits.join(load(spark, d, "supplier").select(F.col("s_suppkey").alias("entry"), F.col("s_suppkey").alias("paper")), "paper").groupBy("q", "entry").agg(F.lit(0).cast("long").alias("direct"), F.count_distinct("paper").alias("papers"))
    both = direct.unionByName(shared).groupBy("q", "entry").agg(F.max("direct").alias("direct"), F.max("papers").alias("papers"))
    score = (F.when(F.col("direct") > 0, 300).otherwise(200) + F.least("direct", F.lit(10)) + F.least("papers", F.lit(5))).cast("int")
    return R.best(both.withColumn("score", score), ["q"], [F.desc("score"), F.asc("entry")], 3).select("q", "entry", "score", "rank")


@query("""WITH s AS (SELECT q.vec_id AS name_id, p.vec_id AS entry_id, q.label = p.label AS same, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9) AS s FROM embeddings q, embeddings p WHERE q.vec_id % 10 = 1 AND p.vec_id % 10 <> 1),
b AS (SELECT *, row_number() OVER (PARTITION BY name_id ORDER BY s DESC, entry_id) AS n FROM s)
SELECT name_id, CASE WHEN s >= 0.6 THEN entry_id END AS entry_id, CASE WHEN s < 0.6 THEN 'novel' WHEN s >= 0.9 AND same THEN 'match' ELSE 'review' END AS decision FROM b WHERE n = 1""")
def concept_resolution(spark: SparkSession, d: str) -> DataFrame:
    """New names against known concepts: nearest vector, merged from 0.9 in the same class, reviewed from 0.6."""
    all_ = load(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    known = all_.where("vec_id % 10 <> 1")
    near = R.dense(known.select(F.col("vec_id").alias("chunk_id"), "vector"), all_.where("vec_id % 10 = 1").select(F.col("vec_id").alias("query_id"), "vector"), 1)
    near = near.join(all_.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id").join(known.select(F.col("vec_id").alias("chunk_id"), "label"), "chunk_id")
    decision = F.when(F.col("score_dense") < 0.6, "novel").when((F.col("score_dense") >= 0.9) & (F.col("own") == F.col("label")), "match").otherwise("review")
    return near.select(F.col("query_id").alias("name_id"), F.when(F.col("score_dense") >= 0.6, F.col("chunk_id")).alias("entry_id"), decision.alias("decision"))


@query("SELECT DISTINCT CASE WHEN l_suppkey = 3 THEN 5 ELSE l_suppkey END AS entry_id, l_partkey FROM lineitem")
def merge_entries(spark: SparkSession, d: str) -> DataFrame:
    edges = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("entry_id"), "l_partkey")
    return S.merge_edges(edges, F.lit(3), F.lit(5).cast("long"))


@query("""WITH n AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1),
e AS (SELECT s_suppkey, s_name, coalesce(n, 0) AS n, s_nationkey AS version, s_acctbal FROM supplier LEFT JOIN n ON l_suppkey = s_suppkey),
i AS (SELECT s_suppkey AS entry_id, array_to_string(list_filter([CASE WHEN length(s_name) < 40 THEN 'definition_too_short' END, CASE WHEN n = 0 THEN 'no_key_papers' END, CASE WHEN version > 10 AND n < 1 THEN 'high_version_no_evidence' END, CASE WHEN s_suppkey % 9 = 0 THEN 'empty_normalized_label' END, CASE WHEN s_suppkey % 4 = 0 THEN 'self_related' END], lambda x: x IS NOT NULL), ',') AS issues FROM e)
SELECT * FROM i WHERE issues <> ''""")
def consistency_checks(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count_distinct("l_partkey").alias("n"))
    entries = load(spark, d, "supplier").join(n, "s_suppkey", "left").select(
        F.col("s_suppkey").alias("entry_id"), F.col("s_name").alias("definition"), F.coalesce("n", F.lit(0)).alias("n_papers"), F.coalesce("n", F.lit(0)).alias("n_evidence"), F.col("s_nationkey").alias("version"),
        F.array("s_name", F.when(F.col("s_suppkey") % 9 == 0, "--").otherwise("x")).alias("labels"), F.array(F.when(F.col("s_suppkey") % 4 == 0, F.col("s_suppkey")).otherwise(-1)).alias("related"),
    )
    return S.concept_issues(entries).select("entry_id", F.array_join("issues", ",").alias("issues"))


@query("""SELECT n_regionkey AS entry_id, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1""")
def compose_entries(spark: SparkSession, d: str) -> DataFrame:
    regions = load(spark, d, "region").select(F.col("r_regionkey").alias("entry_id"))
    edges = load(spark, d, "nation").select(F.col("n_regionkey").alias("entry_id"), "n_nationkey", "n_name")
    return S.compose(regions, edges, "n_name", "n_nationkey", "names").where("size(names) > 0").select("entry_id", F.array_join("names", ",").alias("names"))


@query("SELECT DISTINCT l_suppkey AS entry_id, l_partkey FROM lineitem")
def append_edges(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("entry_id"), "l_partkey", "l_orderkey")
    return S.append_edges(lines.where("l_orderkey % 3 = 0").drop("l_orderkey").distinct(), lines.where("l_orderkey % 3 <> 0").drop("l_orderkey"))


@query("SELECT source AS paper_id, sha1(string_agg(doc_id || chr(9) || sha256(text), chr(10) ORDER BY doc_id || chr(9) || sha256(text))) AS fingerprint FROM documents GROUP BY source")
def content_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").groupBy(F.col("source").alias("paper_id")).agg(S.fingerprint(F.col("doc_id").cast("string"), F.sha2("text", 256)).alias("fingerprint"))


@query("""WITH p AS (SELECT source AS paper_id, count(*) FILTER (doc_id % 12 > 2) AS n FROM documents GROUP BY source) SELECT paper_id, n FROM p WHERE n >= 15 AND paper_id NOT IN ('src3', 'src7')""")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    """Papers with at least 15 text chunks that were not parsed by a barred parser."""
    counts = load(spark, d, "documents").groupBy(F.col("source").alias("paper_id")).agg(F.count_if(F.col("doc_id") % 12 > 2).alias("n"))
    return counts.where((F.col("n") >= 15) & ~F.col("paper_id").isin("src3", "src7"))


@query("SELECT source, doc_id, running FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS running FROM documents) WHERE running <= 16000")
def response_budget(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a response as long as their texts fit 16,000 characters together."""
    from pyspark.sql import Window

    running = F.sum("n_chars").over(Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return load(spark, d, "documents").select("source", "doc_id", running.alias("running")).where("running <= 16000")


@query("SELECT event_id, CASE WHEN json_extract_string(props, '$.page') IS NOT NULL THEN json_extract_string(props, '$.page') ELSE '' END AS page FROM events")
def metadata_decode(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.page"), F.lit("")).alias("page"))


@query("""WITH n AS (SELECT c_custkey AS k, c_nationkey, c_acctbal, c_name FROM customer WHERE c_custkey % 17 <> 1),
o AS (SELECT c_custkey AS k, c_nationkey, CASE WHEN c_custkey % 5 = 2 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 7 = 3 THEN c_name || '.' ELSE c_name END AS c_name, c_custkey::VARCHAR AS vector FROM customer WHERE c_custkey % 19 <> 1)
SELECT k AS point_id, CASE WHEN o.k IS NULL OR n.c_name <> o.c_name THEN 'vector' WHEN n.c_acctbal <> o.c_acctbal THEN 'payload' ELSE 'skip' END AS action, n.c_name AS content_id, n.c_acctbal::VARCHAR AS payload_fingerprint,
  CASE WHEN o.k IS NULL OR n.c_name <> o.c_name THEN 'new' ELSE o.vector END AS vector FROM n LEFT JOIN o USING (k)""")
def increment_apply(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")

    def points(rows, name, balance, vector):
        return rows.select(k.alias("point_id"), name.alias("content_id"), F.lit("v").alias("embedding_version"), balance.cast("string").alias("payload_fingerprint"), vector.alias("vector"))

    rows, name, balance = load(spark, d, "customer"), F.col("c_name"), F.col("c_acctbal")
    new = points(rows.where("c_custkey % 17 <> 1"), name, balance, F.lit("new"))
    old = points(rows.where("c_custkey % 19 <> 1"), F.when(k % 7 == 3, F.concat(name, F.lit("."))).otherwise(name), F.when(k % 5 == 2, balance + 1).otherwise(balance), k.cast("string"))
    return S.apply_diff(new, old).select("point_id", "action", "content_id", "payload_fingerprint", "vector")


@query("""WITH t AS (SELECT c_custkey AS chunk_id, c_nationkey AS paper_id, array_to_string(regexp_extract_all(lower(c_name || ' ' || c_mktsegment), '[a-z0-9_]+'), ' ') AS text FROM customer)
SELECT chunk_id, paper_id, text FROM t WHERE paper_id % 3 <> 2""")
def index_sync(spark: SparkSession, d: str) -> DataFrame:
    """The mirror knew old names of all papers; of every third the chunks were deleted, another third came anew, the rest had not changed."""
    rows = load(spark, d, "customer").select(F.col("c_custkey").alias("chunk_id"), F.col("c_nationkey").alias("paper_id"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("text"))
    before = rows.withColumn("text", F.when(F.col("paper_id") % 3 == 0, F.col("text")).otherwise("old name"))
    return I.sync(I.rows(before), rows.where("paper_id % 3 <> 2"), rows.where("paper_id % 3 <> 0").select("paper_id"))


@query("SELECT (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) AS indexed, (SELECT count(*) FROM customer) AS chunks, (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) <> (SELECT count(*) FROM customer) AS stale")
def index_stale(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "customer")
    return I.stale(rows.where("c_custkey % 2 = 0"), rows)


@query("SELECT l_orderkey AS entry_id, '[' || string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) || ']' AS lines FROM lineitem GROUP BY l_orderkey")
def payload_projection(spark: SparkSession, d: str) -> DataFrame:
    lines = F.array_sort(F.collect_list("l_linenumber")).alias("lines")
    return S.payload(load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("entry_id")).agg(lines, F.count("*").alias("secret")), ("entry_id", "lines", "absent"))
