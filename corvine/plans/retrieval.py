"""Queries of the retrieval core, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fanout
from ..operators import retrieval as R
from ..operators.cells import CellIndex
from ..operators.postings import Index
from ..session import shared_folder
from ..tables import CHUNK_SQL, chunks, load, questions
from .registry import registry

QUERIES, SQL, query = registry()

TOKENS = "regexp_extract_all(lower({}), '[a-z0-9_]+|[一-鿿]+')"


def bm25_sql(k1: float, okapi: bool) -> str:
    idf = "ln((n - df + 0.5) / (df + 0.5))"
    fixed = f"CASE WHEN {idf} < 0 THEN 0.25 * (SELECT avg(ln((n - df + 0.5) / (df + 0.5))) FROM dfs, sizes) ELSE {idf} END" if okapi else f"greatest({idf}, 1e-6)"
    return f"""{CHUNK_SQL}, tok AS (SELECT chunk_id, paper_id, {TOKENS.format("text")} AS t FROM chunk),
  sizes AS (SELECT count(*) AS n, avg(len(t)) AS mean_size FROM tok),
  post AS (SELECT chunk_id, paper_id, len(t) AS size, unnest(t) AS term FROM tok),
  tf AS (SELECT term, chunk_id, paper_id, size, count(*) AS tf FROM post GROUP BY ALL),
  dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  ask AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({TOKENS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
  idfs AS (SELECT term, {fixed} AS idf FROM dfs, sizes),
  sc AS (SELECT query_id, chunk_id, paper_id, round(sum(times * idf * tf * {k1 + 1} / (tf + {k1} * (1 - 0.75 + 0.75 * size / mean_size))), 9) AS score_bm25
    FROM tf JOIN ask USING (term) JOIN idfs USING (term), sizes GROUP BY ALL),
  sparse AS (SELECT query_id, chunk_id, paper_id, score_bm25, rank_bm25 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score_bm25 DESC, chunk_id) - 1 AS rank_bm25 FROM sc WHERE score_bm25 > 0) WHERE rank_bm25 < 20)"""


FTS, OKAPI = bm25_sql(1.2, False), bm25_sql(1.5, True)
_SPARSE_OUT = "SELECT query_id, chunk_id, paper_id, round(score_bm25, 6) AS score_bm25, rank_bm25::INT AS rank_bm25 FROM sparse"


def _rounded(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({n: F.round(n, 6) for n in names})


@query(f"WITH {OKAPI} {_SPARSE_OUT}")
def bm25_okapi_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(R.bm25(chunks(spark, d), questions(spark, d), "okapi"), "score_bm25")


@query(f"WITH {FTS} {_SPARSE_OUT}")
def bm25_fts_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(R.bm25(chunks(spark, d), questions(spark, d), "fts"), "score_bm25")


def _points(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """A question's vector is the one with its id."""
    own = load(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return own.join(questions(spark, d).select("query_id"), "query_id", "left_semi")


DENSE = """sims AS (SELECT q.vec_id AS query_id, p.vec_id AS chunk_id, p.label, q.label AS q_label, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9) AS score_dense
    FROM embeddings q, embeddings p WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
  dense AS (SELECT query_id, chunk_id, score_dense, rank_dense FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score_dense DESC, chunk_id) - 1 AS rank_dense FROM sims) WHERE rank_dense < 20)"""


@query(f"WITH {DENSE} SELECT query_id, chunk_id, round(score_dense, 6) AS score_dense, rank_dense::INT AS rank_dense FROM dense")
def dense_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(R.dense(_points(spark, d), _asked(spark, d)), "score_dense")


@query("""WITH sims AS (SELECT q.vec_id AS query_id, p.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9) AS s
  FROM embeddings q, embeddings p WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND p.label IN (1, 2, 3))
SELECT query_id, chunk_id, round(s, 6) AS score_dense, r::INT AS rank_dense FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) - 1 AS r FROM sims) WHERE r < 10""")
def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    points = _points(spark, d).where(F.col("label").isin(1, 2, 3))
    return _rounded(R.dense(points, _asked(spark, d), 10), "score_dense")


def _legs(spark: SparkSession, d: str) -> DataFrame:
    sparse = R.bm25(chunks(spark, d), questions(spark, d), "fts")
    dense = R.dense(_points(spark, d), _asked(spark, d))
    return R.rrf([(dense, "rank_dense"), (sparse, "rank_bm25")], keep=("score_dense", "score_bm25"))


RRF = f"""{FTS}, {DENSE},
  fused AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, score_dense, score_bm25,
      round(coalesce(1.0::DOUBLE / (60 + rank_dense + 1), 0) + coalesce(1.0::DOUBLE / (60 + rank_bm25 + 1), 0), 9) AS score_rrf,
      CASE WHEN rank_dense IS NOT NULL THEN 0 ELSE 1 END AS leg, coalesce(rank_dense, rank_bm25) AS rk
    FROM dense a FULL JOIN sparse b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id),
  hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score_rrf DESC, leg, rk, chunk_id) - 1 AS position FROM fused) WHERE position < 20)"""


@query(f"WITH {RRF} SELECT query_id, chunk_id, score_rrf, round(score_dense, 6) AS score_dense, round(score_bm25, 6) AS score_bm25 FROM fused")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_legs(spark, d).drop("seen"), "score_dense", "score_bm25")


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    return R.fused_top(_legs(spark, d), 20)


@query(f"WITH {RRF} SELECT query_id, chunk_id, score_rrf, position::INT AS position FROM hybrid")
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).select("query_id", "chunk_id", "score_rrf", "position")


def _described(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid rows with what their chunks are; texts join last."""
    return _hybrid(spark, d).join(chunks(spark, d), "chunk_id")


POOL = f"""{RRF}, full_rows AS (SELECT h.*, c.paper_id, c.section, c.modality, c.text FROM hybrid h JOIN chunk c USING (chunk_id))"""


@query(f"""WITH {POOL}, runs AS (SELECT query_id % 20 AS query_id, chunk_id, score_rrf, query_id * 1000 + position AS seq FROM full_rows)
SELECT query_id, chunk_id, score_rrf, seq FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score_rrf DESC, seq) AS n FROM runs) WHERE n = 1""")
def multi_query_pool(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose ids agree modulo 20 stand for variants of one question."""
    runs = _described(spark, d).select((F.col("query_id") % 20).alias("query_id"), "chunk_id", "score_rrf", (F.col("query_id") * 1000 + F.col("position")).alias("seq"))
    return R.pool(runs)


@query(f"""WITH {POOL}, pen AS (SELECT query_id, chunk_id, section, section = 'References' AS reference_penalized, round(CASE WHEN section = 'References' THEN score_rrf * 0.15 ELSE score_rrf END, 9) AS score_effective, position FROM full_rows)
SELECT query_id, chunk_id, reference_penalized, score_effective, (row_number() OVER (PARTITION BY query_id ORDER BY score_effective DESC, position) - 1)::INT AS rank FROM pen""")
def reference_penalty_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = R.penalise(_described(spark, d).drop("score_dense", "score_bm25")).withColumn("score_effective", F.round("score_effective", 9))
    return R.best(rows, ["query_id"], [F.desc("score_effective"), F.asc("position")], 1000).select("query_id", "chunk_id", "reference_penalized", "score_effective", "rank")


@query(f"""WITH {POOL}, own AS (SELECT query_id, chunk_id, paper_id, position, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY position) > 1 AS over FROM full_rows)
SELECT query_id, chunk_id, paper_id, position FROM (SELECT query_id, chunk_id, paper_id, (row_number() OVER (PARTITION BY query_id ORDER BY over, position) - 1)::INT AS position FROM own) WHERE position < 12""")
def diversify_per_paper(spark: SparkSession, d: str) -> DataFrame:
    rows = _described(spark, d).withColumnRenamed("position", "place")
    return R.diversify(rows, 1, 12, [F.asc("place")]).select("query_id", "chunk_id", "paper_id", "position")


DECISION = """CASE WHEN s < 0.21 THEN 'no_evidence' WHEN s < 0.48 THEN 'weak_evidence' ELSE 'confident' END"""


@query(f"""WITH {POOL}, v AS (SELECT query_id, chunk_id, least(1.0, greatest(0.0, score_dense)) AS v FROM full_rows),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC NULLS LAST, chunk_id) AS k FROM v),
s AS (SELECT query_id, count(*) AS n_chunks, round(avg(v) FILTER (k <= 3), 9) AS s FROM n GROUP BY query_id)
SELECT query_id, n_chunks, 'score_dense' AS field, round(s, 4) AS evidence_score, {DECISION} AS decision, 'high' AS signal_quality FROM s""")
def abstain_decision(spark: SparkSession, d: str) -> DataFrame:
    return R.decide(_described(spark, d))


@query(f"""WITH {POOL}, v AS (SELECT query_id, chunk_id, 1 / (1 + exp(-0.5 * (score_bm25 - 8))) AS v FROM full_rows),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC NULLS LAST, chunk_id) AS k FROM v)
SELECT query_id, count(*) AS n_chunks, 'score_bm25' AS field, round(avg(v) FILTER (k <= 3), 4) AS evidence_score, 'confident' AS decision, 'low_degraded' AS signal_quality FROM n GROUP BY query_id""")
def evidence_score(spark: SparkSession, d: str) -> DataFrame:
    return R.decide(_described(spark, d).drop("score_dense", "score_rrf"))


SELECT_TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


@query(f"""WITH {POOL}, base AS (SELECT f.*, b.text AS query, row_number() OVER (PARTITION BY query_id ORDER BY position) AS rank FROM full_rows f JOIN benchmark b ON b.item_id = f.query_id WHERE section <> 'References'),
o AS (SELECT *, len(list_intersect({SELECT_TOKENS.format("query")}, {SELECT_TOKENS.format("section || ' ' || text")}))::DOUBLE / len({SELECT_TOKENS.format("query")}) AS overlap,
  regexp_matches(lower(section), 'abstract|introduction|method|approach|experiment|evaluation|result|conclusion')::INT AS hint FROM base),
s AS (SELECT *, round(round(score_rrf + 0.2::DOUBLE * overlap + 0.03::DOUBLE * hint + 0.001::DOUBLE / rank, 9), 6) AS select_score FROM o),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY select_score DESC, rank) AS own FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY select_score DESC, rank) - 1 AS selected FROM p WHERE own <= 2)
SELECT query_id, chunk_id, paper_id, select_score, selected::INT AS selected FROM k WHERE selected < 4""")
def evidence_select(spark: SparkSession, d: str) -> DataFrame:
    rows = _described(spark, d).drop("score_dense", "score_bm25").join(questions(spark, d), "query_id")
    return R.select_evidence(rows).select("query_id", "chunk_id", "paper_id", "select_score", "selected")


ANSWER = "text || ' [chunk:' || conv_id || '] see [' || (turn + 1) || '] and [chunk:' || (conv_id + 1) || '] (Smith et al., 2017) [chunk:' || conv_id || ']'"


def _answers(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat("text", F.lit(" [chunk:"), "conv_id", F.lit("] see ["), F.col("turn") + 1, F.lit("] and [chunk:"), F.col("conv_id") + 1, F.lit("] (Smith et al., 2017) [chunk:"), "conv_id", F.lit("]"))
    return load(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", made.alias("answer"))


@query(f"""SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN conv_id::VARCHAR ELSE '' END AS valid,
  length(CASE WHEN conv_id % 3 = 0 THEN replace(a, '[chunk:' || (conv_id + 1) || ']', '') ELSE replace(replace(a, '[chunk:' || (conv_id + 1) || ']', ''), '[chunk:' || conv_id || ']', '') END)::INT AS cleaned_chars
FROM (SELECT conv_id, turn, {ANSWER} AS a FROM conversations WHERE role = 'assistant')""")
def citation_validate(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose ids are multiples of 3 count as retrieved."""
    got = F.array_compact(F.array(F.when(F.col("conv_id") % 3 == 0, F.col("conv_id").cast("string"))))
    rows = _answers(spark, d).withColumn("got", got)
    return rows.select("conv_id", "turn", F.array_join(T.valid_citations(F.col("answer"), F.col("got")), ",").alias("valid"), F.length(T.without_invalid(F.col("answer"), F.col("got"))).alias("cleaned_chars"))


@query(f"""SELECT conv_id, turn, len(regexp_extract_all(a, '\\[[0-9]{{1,3}}\\]'))::INT AS n_numeric, len(regexp_extract_all(a, '\\(\\s*[A-Z][A-Za-zÀ-ſ.\\-]+(\\s+et\\s+al\\.?)?(\\s*,)?\\s*(18|19|20)[0-9]{{2}}[a-z]?\\s*\\)'))::INT AS n_author_year
FROM (SELECT conv_id, turn, {ANSWER} AS a FROM conversations WHERE role = 'assistant')""")
def suspicious_citations(spark: SparkSession, d: str) -> DataFrame:
    rows = _answers(spark, d)
    return rows.select("conv_id", "turn", F.size(T.suspicious(F.col("answer"), "numeric", "numeric_wide")).alias("n_numeric"), F.size(T.suspicious(F.col("answer"), "author_year", "author_year_wide")).alias("n_author_year"))


def _cue_sql(name: str) -> str:
    return " OR ".join(f"contains(' ' || lower(text) || ' ', '{c}')" for c in T.INTENT_CUES["en"][name])


@query(f"""WITH i AS (SELECT conv_id, turn, CASE WHEN {_cue_sql("explore")} THEN 'explore' WHEN {_cue_sql("reasoning")} THEN 'reasoning' WHEN {_cue_sql("factual")} THEN 'factual' ELSE 'reasoning' END AS intent FROM conversations WHERE role = 'user')
SELECT *, (CASE intent WHEN 'factual' THEN 5 WHEN 'reasoning' THEN 10 ELSE 15 END)::INT AS top_k, (CASE intent WHEN 'factual' THEN 1 WHEN 'reasoning' THEN 2 ELSE 3 END)::INT AS max_iter FROM i""")
def intent_classify(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.intent(F.col("text")).alias("intent"))
    return rows.select("*", T.tier(F.col("intent"), 0).alias("top_k"), T.tier(F.col("intent"), 1).alias("max_iter"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[㐀-䶿一-鿿豈-﫿]') THEN 'zh' ELSE 'en' END AS lang FROM conversations WHERE role = 'user'")
def query_language(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.query_language(F.col("text")).alias("lang"))


def _modality_sql(name: str) -> str:
    return "CASE WHEN " + " OR ".join(f"contains(lower(text), '{c}')" for c in T.MODALITY_CUES[name]) + f" THEN '{name}' END"


@query("SELECT conv_id, turn, array_to_string(list_filter([" + ", ".join(_modality_sql(m) for m in T.MODALITY_CUES) + "], lambda x: x IS NOT NULL), ',') AS modalities FROM conversations WHERE role = 'user'")
def modality_infer(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(T.modalities(F.col("text")), ",").alias("modalities"))


@query("""WITH q AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+')[1:3] AS p FROM benchmark),
t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM documents),
x AS (SELECT doc_id, t[i] AS a, t[i+1] AS b, t[i+2] AS c FROM (SELECT doc_id, t, unnest(range(1, len(t) - 1)) AS i FROM t))
SELECT item_id AS phrase_id, doc_id AS chunk_id, count(*) AS hits FROM x JOIN q ON a = p[1] AND b = p[2] AND c = p[3] GROUP BY ALL""")
def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    """The first three tokens of each question as a phrase."""
    phrases = questions(spark, d).select(F.col("query_id").alias("phrase_id"), F.array_join(F.slice(T.index_tokens(F.col("query")), 1, 3), " ").alias("phrase"))
    return R.phrase_hits(chunks(spark, d), phrases)


@query("SELECT conv_id, turn, regexp_matches(trim(regexp_replace(text, '\\s+', ' ', 'g')), '(?i)\\bbibliograph(y|ies)\\b|\\breference\\s+list\\b|\\bcitation\\s+list\\b|\\bcited\\s+(papers?|works?|references?)\\b|\\bwhich\\s+(papers?|works?)\\b[^?]*\\bcited\\b') AS asks FROM conversations WHERE role = 'user'")
def reference_intent(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.reference_intent(F.col("text")).alias("asks"))


@query(f"""WITH {POOL}, r AS (SELECT query_id, chunk_id, section, row_number() OVER (PARTITION BY query_id ORDER BY position) AS n FROM full_rows WHERE position < 12)
SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY n) - 1)::INT AS rank FROM r WHERE section <> 'References' QUALIFY rank < 4""")
def overfetch_filter(spark: SparkSession, d: str) -> DataFrame:
    """Three times as many rows as wanted, without references, cut to what is wanted."""
    rows = _described(spark, d).where("position < 12").where(~T.is_reference(F.col("section")))
    return R.best(rows, ["query_id"], [F.asc("position")], 4).select("query_id", "chunk_id", "rank")


@query(f"""WITH {POOL}, m AS (SELECT query_id, chunk_id, paper_id, '[chunk:' || chunk_id || '] (' || paper_id || ', ' || section || ') ' || CASE WHEN length(text) <= 400 THEN text ELSE rtrim(left(text, 397)) || '...' END AS line, position FROM full_rows WHERE position < 4)
SELECT query_id, length(string_agg(line, chr(10) ORDER BY position))::INT AS chars, count(*) AS n FROM m GROUP BY query_id""")
def evidence_format(spark: SparkSession, d: str) -> DataFrame:
    rows = _described(spark, d).where("position < 4")
    line = F.concat(F.lit("[chunk:"), F.col("chunk_id"), F.lit("] ("), "paper_id", F.lit(", "), "section", F.lit(") "), T.clip(F.col("text"), 400))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("query_id").agg(F.length(F.array_join(lines, "\n")).alias("chars"), F.count("*").alias("n"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid retrieval of all questions and the evidence for their answers."""
    return evidence_select(spark, d)


def _changed_index(spark: SparkSession, d: str) -> Index:
    """An index of an older corpus, brought up to date by paper: a third of the sources had other texts, a third was not there, and papers that are gone now were."""
    now = chunks(spark, d).select("chunk_id", "paper_id", "text")
    kind = F.pmod(F.crc32("paper_id"), F.lit(3))
    gone = now.where(kind == 2).select((F.col("chunk_id") + 10**9).alias("chunk_id"), F.concat(F.lit("gone-"), "paper_id").alias("paper_id"), "text")
    before = now.where(kind != 1).withColumn("text", F.when(kind == 0, F.reverse("text")).otherwise(F.col("text"))).unionByName(gone)
    index = Index(spark, shared_folder(spark, "index")).build(before, "plain")
    index.sync(now, gone.select("paper_id").union(now.where(kind != 2).select("paper_id")))
    return index


@query(f"WITH {FTS} {_SPARSE_OUT}")
def kept_index_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_changed_index(spark, d).search(questions(spark, d), "fts", 20), "score_bm25")


@query(f"WITH {CHUNK_SQL} SELECT term, count(DISTINCT chunk_id) AS df FROM (SELECT chunk_id, unnest({TOKENS.format('text')}) AS term FROM chunk) GROUP BY term")
def kept_index_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return _changed_index(spark, d).frequencies()


#: Each question has the next one as a variant, and every other question asks for figures too.
_SPECS = """item AS (SELECT item_id, text FROM benchmark), spec AS (SELECT a.item_id AS q, b.item_id - a.item_id AS v, b.item_id AS other, m
  FROM item a JOIN item b ON b.item_id IN (a.item_id, a.item_id + 1), LATERAL (SELECT unnest(CASE WHEN a.item_id % 2 = 0 THEN [NULL, 'figure'] ELSE [NULL] END) AS m))"""


def _rewritten(spark: SparkSession, d: str) -> DataFrame:
    asked = questions(spark, d)
    after = asked.select((F.col("query_id") - 1).alias("query_id"), F.col("query").alias("next"))
    figure = F.when(F.col("query_id") % 2 == 0, F.array(F.lit("figure"))).otherwise(F.array().cast("array<string>"))
    return asked.join(after, "query_id", "left").select("query_id", "query", F.array_compact(F.array("query", "next")).alias("dense_queries"), F.lit("").alias("bm25_query"), figure.alias("modalities"))


@query(f"WITH {_SPECS} SELECT q AS query_id, v::INT AS variant, m AS modality, count(*) AS n FROM spec GROUP BY ALL")
def fanout_specs(spark: SparkSession, d: str) -> DataFrame:
    return fanout.specs(_rewritten(spark, d)).groupBy("query_id", "variant", "modality").agg(F.count("*").alias("n"))


@query(f"""WITH {FTS}, {_SPECS},
sims AS (SELECT q.vec_id AS other, p.vec_id AS chunk_id, chunk.modality, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9) AS s
  FROM embeddings q, embeddings p JOIN chunk ON chunk.chunk_id = p.vec_id WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
dl AS (SELECT q, v, m, chunk_id, s, row_number() OVER (PARTITION BY q, v, m ORDER BY s DESC, chunk_id) - 1 AS r FROM spec JOIN sims USING (other) WHERE m IS NULL OR m = modality QUALIFY r < 20),
sl AS (SELECT q, v, m, chunk_id, row_number() OVER (PARTITION BY q, v, m ORDER BY rank_bm25) - 1 AS r FROM spec JOIN sparse ON other = query_id JOIN chunk USING (chunk_id) WHERE m IS NULL OR m = modality),
legs AS (SELECT q, v, m, chunk_id, r, 0 AS leg FROM dl UNION ALL SELECT q, v, m, chunk_id, r, 1 FROM sl),
fused AS (SELECT q, v, m, chunk_id, round(sum(1.0 / (61 + r)), 9) AS rrf, min((leg, r)) AS seen FROM legs GROUP BY q, v, m, chunk_id),
listed AS (SELECT *, row_number() OVER (PARTITION BY q, v, m ORDER BY rrf DESC, seen, chunk_id) - 1 AS p FROM fused QUALIFY p < 20),
pooled AS (SELECT q, chunk_id, min((v, m IS NOT NULL, p)) AS seq, max(rrf) AS rrf, arg_min((v, m), (-rrf, v, m IS NOT NULL, p)) AS best FROM listed GROUP BY q, chunk_id),
full_ AS (SELECT pooled.*, paper_id, section, rrf * CASE WHEN section = 'References' AND NOT regexp_matches(item.text, '(?i)\\b(bibliograph(y|ies)|reference\\s+list|citation\\s+list|cited\\s+(papers?|works?|references?))\\b') THEN 0.15 ELSE 1 END AS eff
  FROM pooled JOIN chunk USING (chunk_id) JOIN item ON item_id = q),
win AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY eff DESC, seq) AS place FROM full_ QUALIFY place <= 30),
own AS (SELECT *, row_number() OVER (PARTITION BY q, paper_id ORDER BY place) AS o FROM win)
SELECT q AS query_id, chunk_id, round(eff, 6) AS score_effective, best[1]::INT AS variant, best[2] AS modality, (row_number() OVER (PARTITION BY q ORDER BY o > 3, place) - 1)::INT AS position FROM own QUALIFY position < 10""")
def fanout_round(spark: SparkSession, d: str) -> DataFrame:
    """A variant's vector is the one with the id of its question."""
    corpus, rewritten = chunks(spark, d), _rewritten(spark, d)
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    points = vectors.join(corpus.select("chunk_id", "modality"), "chunk_id")
    number = F.floor(F.col("spec_id") / fanout.MODALITIES)
    dense = lambda asked: R.dense(points, asked.withColumn("chunk_id", F.floor(number / fanout.VARIANTS) + number % fanout.VARIANTS).join(vectors, "chunk_id").select(F.col("spec_id").alias("query_id"), "vector", "modality"), 20, "modality")
    rows = fanout.retrieve(rewritten, corpus, dense, lambda asked: R.bm25(corpus, asked, "fts", 20), fanout.Round(per_paper=3))
    return rows.select("query_id", "chunk_id", F.round("score_effective", 6).alias("score_effective"), "variant", F.col("asked_modality").alias("modality"), F.col("position").cast("int").alias("position"))


def _cells(spark: SparkSession, d: str) -> CellIndex:
    """The vectors by cells; every seventh came later, and had another vector before."""
    rows = load(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("paper_id"), F.col("embedding").alias("vector"))
    late = F.col("paper_id").cast("int") % 7 == 3
    index = CellIndex(spark, shared_folder(spark, "cells")).build(rows.withColumn("vector", F.when(late, F.reverse("vector")).otherwise(F.col("vector"))))
    index.sync(rows, rows.where(late).select("paper_id"))
    return index


@query(f"WITH {DENSE} SELECT query_id, chunk_id, round(score_dense, 6) AS score_dense, rank_dense::INT AS rank_dense FROM dense")
def cells_topk_exact(spark: SparkSession, d: str) -> DataFrame:
    """By the exact way through the cells."""
    return _rounded(_cells(spark, d).search(_asked(spark, d), 20, exact=True), "score_dense")
