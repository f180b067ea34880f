"""Queries over raw documents and pages: identities, languages, chunks, sections, cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking
from ..functions import text as T
from ..operators import retrieval as R
from ..operators import store as S
from ..operators import visual as V
from ..sources import identifiers as I
from ..tables import CHUNK_SQL, chunks, load
from .registry import registry

QUERIES, SQL, query = registry()


@query("""WITH n AS (SELECT page_id, regexp_replace(lower(regexp_extract(html, '<title>([^<]*)', 1)), '[^\\p{L}\\p{N}]+', '', 'g') AS norm FROM pages)
SELECT page_id, first_id FROM (SELECT page_id, min(page_id) OVER (PARTITION BY norm) AS first_id FROM n WHERE norm <> '') WHERE first_id < page_id""")
def title_norm_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose normalised title an earlier one has."""
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    pages = load(spark, d, "pages").select("page_id", T.title_norm(title).alias("norm")).where("norm <> ''")
    first = pages.groupBy("norm").agg(F.min("page_id").alias("first_id"))
    return pages.join(first, "norm").where("first_id < page_id").select("page_id", "first_id")


@query("""WITH k AS (SELECT page_id AS id, regexp_extract(url, '/([0-9]+)', 1) AS doi, regexp_extract(url, '://([^/]+)', 1) AS arxiv, regexp_replace(lower(regexp_extract(html, '<title>([^<]*)', 1)), '[^a-z0-9]+', '', 'g') AS title FROM pages),
old AS (SELECT * FROM k WHERE id % 2 = 0), new AS (SELECT * FROM k WHERE id % 2 = 1),
d AS (SELECT doi, min(id) AS m FROM old GROUP BY 1), a AS (SELECT arxiv, min(id) AS m FROM old GROUP BY 1), t AS (SELECT title, min(id) AS m FROM old GROUP BY 1)
SELECT id, coalesce(d.m, a.m, t.m) AS match_id, CASE WHEN d.m IS NOT NULL THEN 'doi' WHEN a.m IS NOT NULL THEN 'arxiv' WHEN t.m IS NOT NULL THEN 'title' END AS matched_by
FROM new LEFT JOIN d USING (doi) LEFT JOIN a USING (arxiv) LEFT JOIN t USING (title)""")
def source_priority_dedup(spark: SparkSession, d: str) -> DataFrame:
    """New pages against old ones: by the number in the URL, then the host, then the title."""
    title = F.regexp_replace(F.lower(F.regexp_extract("html", "<title>([^<]*)", 1)), "[^a-z0-9]+", "")
    keys = load(spark, d, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("url", "/([0-9]+)", 1).alias("doi"), F.regexp_extract("url", "://([^/]+)", 1).alias("arxiv"), title.alias("title"))
    return S.first_match(keys.where("id % 2 = 1"), keys.where("id % 2 = 0"), "id", ("doi", "arxiv", "title"))


@query("SELECT doc_id, greatest(1, length(regexp_replace(text, '[^⺀-鿿豈-﫿＀-￯]', '', 'g')) + ((length(text) - length(regexp_replace(text, '[^⺀-鿿豈-﫿＀-￯]', '', 'g'))) // 4))::INT AS n_tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("n_tokens"))


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_frame(load(spark, d, "documents")).drop("text")


@query("SELECT count(*) AS n_documents, 0::BIGINT AS broken_spans, 0::BIGINT AS overlong FROM documents WHERE regexp_matches(text, '\\S')")
def chunk_span_invariant(spark: SparkSession, d: str) -> DataFrame:
    """Chunks are what their spans say, and none is over the target."""
    docs = load(spark, d, "documents")
    cut = chunking.chunk_frame(docs).alias("c").join(docs.select("doc_id", F.col("text").alias("body")), "doc_id")
    wrong = F.substring("body", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) != F.col("text")
    return cut.agg(F.count_distinct("doc_id").alias("n_documents"), F.count_if(wrong).alias("broken_spans"), F.count_if(F.col("n_tokens") > 1000).alias("overlong"))


@query("""WITH r AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: starts_with(x, '|') AND ends_with(x, '|') AND contains(trim(x, '|'), '|')) AS rows FROM documents)
SELECT doc_id, len(rows)::INT AS n_rows, len(rows) >= 2 AS is_table FROM r""")
def table_block_detect(spark: SparkSession, d: str) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(x))
    rows = F.filter(lines, lambda x: x.startswith("|") & x.endswith("|") & F.contains(F.btrim(x, F.lit("|")), F.lit("|")))
    return load(spark, d, "documents").select("doc_id", F.size(rows).alias("n_rows"), (F.size(rows) >= 2).alias("is_table"))


@query("SELECT doc_id, CASE WHEN c >= 20 AND c / (c + l) >= 0.05 THEN 'zh' WHEN l >= 50 THEN 'en' END AS language FROM (SELECT doc_id, length(regexp_replace(text, '[^一-鿿]', '', 'g')) AS c, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l FROM documents)")
def document_language(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", T.document_language(F.col("text")).alias("language"))


@query("SELECT doc_id, left(sha1(source || '::' || (doc_id % 10) || '::text::' || doc_id), 20) AS chunk_id, left(sha1(source || '::sec::' || (doc_id % 10)), 16) AS section_id, sha256(text) AS content_id FROM documents")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    part = F.col("doc_id") % 10
    return docs.select("doc_id", T.chunk_id(F.col("source"), part, F.lit("text"), F.col("doc_id")).alias("chunk_id"), T.section_id(F.col("source"), part).alias("section_id"), F.sha2("text", 256).alias("content_id"))


@query("""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(source || ':' || doc_id)) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""")
def point_ids(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("source", F.lit(":"), F.col("doc_id").cast("string"))
    return load(spark, d, "documents").select("doc_id", T.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", name).alias("point_id"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)', 1)) AS title, trim(regexp_replace(html, '(?s)<[^>]*>', '', 'g')) <> '' AS meaningful FROM pages")
def html_title_extract(spark: SparkSession, d: str) -> DataFrame:
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>([^<]*)", 1))
    return load(spark, d, "pages").select("page_id", title.alias("title"), I.is_meaningful(F.col("html"), "(?s)<[^>]*>").alias("meaningful"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://api.openalex.org/works/doi:10.1/' || page_id WHEN page_id % 3 = 1 THEN 'https://api.openalex.org/works/W' || page_id ELSE 'https://api.openalex.org/works/W' || page_id END AS request_url FROM pages""")
def url_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers made of page ids in three forms: DOI, catalogue URL, bare id."""
    n = F.col("page_id").cast("string")
    given = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("10.1/"), n)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://openalex.org/W"), n)).otherwise(F.concat(F.lit("W"), n))
    return load(spark, d, "pages").select("page_id", I.openalex_request(given).alias("request_url"))


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'arXiv:' || '2101.' || lpad((page_id % 100000)::VARCHAR, 5, '0') ELSE 'DOI:10.5/' || page_id END AS s2_id FROM pages""")
def scholar_id_normalise(spark: SparkSession, d: str) -> DataFrame:
    arxiv = F.concat(F.lit("2101."), F.lpad((F.col("page_id") % 100000).cast("string"), 5, "0"))
    given = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("arxiv:"), arxiv, F.lit("v2"))).otherwise(F.concat(F.lit("https://doi.org/10.5/"), F.col("page_id").cast("string")))
    return load(spark, d, "pages").select("page_id", I.scholar_id(given).alias("s2_id"))


@query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || '.pdf' END AS a, CASE WHEN page_id % 3 = 0 THEN url || '/b.pdf' END AS b, url AS c FROM pages) SELECT page_id, coalesce(a, b, c) AS pdf_url FROM p""")
def pdf_location(spark: SparkSession, d: str) -> DataFrame:
    pages = load(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit(".pdf"))).alias("best"), F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("/b.pdf"))).alias("primary"), F.array(F.lit(None).cast("string"), "url").alias("others"))
    return pages.select("page_id", I.first_pdf(F.col("best"), F.col("primary"), F.col("others")).alias("pdf_url"))


@query(f"""WITH {CHUNK_SQL} SELECT chunk_id, sha1('[Title: ' || paper_id || '] [Section: ' || section || ']' || chr(10) || text) AS digest FROM chunk""")
def context_prefix(spark: SparkSession, d: str) -> DataFrame:
    made = T.with_context(F.col("text"), F.col("paper_id"), F.col("section"))
    return chunks(spark, d).select("chunk_id", F.sha1(made).alias("digest"))


@query("""SELECT doc_id, 'Paper metadata record.' || chr(10) || 'Title: ' || rtrim(left(text, 40)) || chr(10) || 'Paper id: ' || source || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Year: ' || (2000 + doc_id % 25) ELSE '' END || chr(10) || 'Abstract: ' || trim(regexp_replace(left(text, 200), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS card FROM documents""")
def metadata_card(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    card = I.metadata_card(title=F.rtrim(F.left("text", F.lit(40))), paper_id=F.col("source"), year=F.when(F.col("doc_id") % 2 == 0, 2000 + F.col("doc_id") % 25), abstract=F.left("text", F.lit(200)))
    return docs.select("doc_id", card.alias("card"))


@query("""WITH n AS (SELECT source, list(DISTINCT list_extract(['Abstract','Introduction','Related Work','Method','Approach','Experiments','Results','Discussion','Conclusion','References'], (doc_id % 10)::INT + 1)) AS names FROM documents GROUP BY source),
a AS (SELECT source, lower(array_to_string(names, '|')) AS s FROM n),
f AS (SELECT source, regexp_matches(s, 'abstract|introduction|intro') AS i, regexp_matches(s, 'method|approach|model|framework|architecture|retrieval|generation|augmentation|training|implementation') AS m,
  regexp_matches(s, 'experiment|evaluation|metric|result|ablation|analysis|dataset|task') AS e, regexp_matches(s, 'conclusion|discussion|summary|limitation|future work') AS c FROM a)
SELECT source, CASE WHEN i AND m AND e AND c THEN 'complete' WHEN i AND m AND (e OR c) THEN 'partial' WHEN i OR m THEN 'minimal' ELSE 'broken' END AS grade FROM f""")
def section_completeness(spark: SparkSession, d: str) -> DataFrame:
    has = {a: F.bool_or(T.any_of(F.lower("section"), chunking.AREAS["en"][a])).alias(a) for a in chunking.AREAS["en"]}
    out = chunks(spark, d).groupBy(F.col("paper_id").alias("source")).agg(*has.values())
    i, m, e, c = (F.col(x) for x in ("intro", "method", "experiment", "conclusion"))
    return out.select("source", F.when(i & m & e & c, "complete").when(i & m & (e | c), "partial").when(i | m, "minimal").otherwise("broken").alias("grade"))


@query()
def section_split(spark: SparkSession, d: str) -> DataFrame:
    """Documents with headings put in front of every third line."""
    docs = load(spark, d, "documents")
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("## Part "), i.cast("string"), F.lit("\n"), x)).otherwise(x)), "\n")
    return chunking.section_frame(docs.select("doc_id", marked.alias("text"), "lang"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT doc_id, n::INT AS line_no, trim(regexp_extract(line, '^(#{1,4})\\s+(.+)', 2)) AS name FROM l WHERE regexp_matches(line, '^#{1,4}\\s+\\S')""")
def markdown_headers(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.where(F.col("line").rlike(r"^#{1,4}\s+\S")).select("doc_id", (F.col("n") + 1).alias("line_no"), F.trim(F.regexp_extract("line", r"^(#{1,4})\s+(.+)", 2)).alias("name"))


@query("""WITH p AS (SELECT doc_id, unnest(range(0, length(text), 500)) AS beg FROM documents)
SELECT doc_id, beg AS char_start, lead(beg, 1, length(text)) OVER (PARTITION BY doc_id ORDER BY beg) AS char_end FROM p JOIN documents USING (doc_id)""")
def section_ends(spark: SparkSession, d: str) -> DataFrame:
    """A section ends where the next begins; here one every 500 characters."""
    docs = load(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("size")).where("size > 0")
    starts = docs.select("doc_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(500).cast("long"))).alias("char_start"))
    from pyspark.sql import Window

    nxt = F.lead("char_start").over(Window.partitionBy("doc_id").orderBy("char_start"))
    return starts.select("doc_id", "char_start", F.coalesce(nxt, "size").alias("char_end"))


@query("""WITH w AS (SELECT l_orderkey AS k, l_linenumber AS pos, CASE WHEN l_linenumber % 3 = 1 THEN l_linenumber END AS page FROM lineitem)
SELECT k, pos, max(page) OVER (PARTITION BY k ORDER BY pos) AS page FROM w""")
def page_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The last page marker at or before each place."""
    from pyspark.sql import Window

    rows = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_linenumber") % 3 == 1, F.col("l_linenumber")).alias("page"))
    return rows.select("k", "pos", F.last("page", True).over(Window.partitionBy("k").orderBy("pos")).alias("page"))


#: Parts that messages of failures are made of, so that all classes and their borders come up.
SAID_FIRST = ("Traceback: ", "ModuleNotFoundError: No module named 'cv2' ", "No module named shapely ", "No such file or directory: ", "ConnectionError to ", "Max retries for huggingface.co ", "weights ")
SAID_THEN = ("", "magic-pdf", "https://github.com/x", "model.pt", "Model download broken", "MISSING_MODELS_OR_OFFLINE", "not found", "failed to resolve api.github.com", "mineru ended")


def _part_sql(parts: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in parts) + f"][doc_id % {len(parts)} + 1]"


@query(f"""WITH m AS (SELECT doc_id, lower({_part_sql(SAID_FIRST)} || {_part_sql(SAID_THEN)}) AS e FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(e, 'no module named ''?cv2') THEN 'missing_cv2' WHEN regexp_matches(e, 'no module named ''?(doclayout_yolo|ultralytics|rapid_table|pyclipper|shapely)') THEN 'missing_mineru_full_extra'
  WHEN contains(e, 'no such file or directory') AND regexp_matches(e, 'magic-pdf|mineru') THEN 'missing_cli'
  WHEN contains(e, 'missing_models_or_offline') OR regexp_matches(e, 'github\\.com|huggingface\\.co') AND regexp_matches(e, 'failed to resolve|connectionerror|max retries|environment is not online') THEN 'missing_models_or_offline'
  WHEN contains(e, 'model') AND regexp_matches(e, 'not found|no such file|download') THEN 'missing_models' ELSE 'unknown' END AS category FROM m""")
def failure_classify(spark: SparkSession, d: str) -> DataFrame:
    part = lambda parts: F.get(F.array(*map(F.lit, parts)), (F.col("doc_id") % len(parts)).cast("int"))
    return load(spark, d, "documents").select("doc_id", I.failure(F.concat(part(SAID_FIRST), part(SAID_THEN)))["category"].alias("category"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w)
SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM u GROUP BY doc_id""")
def abstract_decode(spark: SparkSession, d: str) -> DataFrame:
    """An inverted index (word to places) made of each whole text, and read back."""
    words = lambda text: F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))
    texts = load(spark, d, "documents").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    inverted = texts.select("doc_id", I.encode_inverted(F.transform("texts", words)).alias("inverted")).where("size(inverted) > 0")
    return inverted.select("doc_id", I.decode_inverted(F.col("inverted")).alias("text"))


@query("""WITH w AS (SELECT p_partkey, list_filter(regexp_extract_all(p_name, '[A-Za-z][A-Za-z0-9]*'), lambda x: NOT list_contains(['a','an','and','for','in','of','on','the','to','with'], lower(x))) AS w FROM part),
a AS (SELECT p_partkey, unnest(range(1, len(w) - n + 2)) AS i, n, w FROM w, (SELECT unnest([2, 3, 4]) AS n) WHERE len(w) >= n)
SELECT DISTINCT p_partkey, upper(array_to_string(list_transform(w[i:i + n - 1], lambda x: left(x, 1)), '')) AS alias FROM a
UNION SELECT p_partkey, unnest(regexp_extract_all(p_name, '\\b([A-Z][A-Z0-9]{1,7})\\b')) FROM part""")
def title_acronyms(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", F.explode(T.title_acronyms(F.col("p_name"))).alias("alias")).distinct()


@query(f"""WITH {CHUNK_SQL} SELECT chunk_id, section = 'References' OR chunk_id % 50 = 1 AS is_reference, CASE WHEN length(text) <= 60 THEN text ELSE rtrim(left(text, 57)) || '...' END AS clipped FROM chunk""")
def reference_predicate(spark: SparkSession, d: str) -> DataFrame:
    flag = F.when(F.col("chunk_id") % 50 == 1, True)
    return chunks(spark, d).select("chunk_id", T.is_reference(F.col("section"), flag).alias("is_reference"), T.clip(F.col("text"), 60).alias("clipped"))


@query("""WITH t AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS l FROM documents),
u AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM t)
SELECT doc_id, count(*) AS n_lines, min(pos) AS first_pos FROM (SELECT doc_id, line, pos, row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY pos) AS n FROM u WHERE line <> '') WHERE n = 1 GROUP BY doc_id""")
def ordered_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Lines equal but for case and blanks stay once, the first of them."""
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.transform(F.split("text", "\n"), T.collapsed)).alias("pos", "line")).where("line <> ''")
    first = R.best(lines.withColumn("low", F.lower("line")), ["doc_id", "low"], [F.asc("pos")], 1)
    return first.groupBy("doc_id").agg(F.count("*").alias("n_lines"), (F.min("pos") + 1).cast("long").alias("first_pos"))


@query("""WITH w AS (SELECT p_partkey, p_name, list_filter(regexp_extract_all(p_name, '[A-Za-z][A-Za-z0-9]*'), lambda x: NOT list_contains(['a','an','and','for','in','of','on','the','to','with'], lower(x))) AS w FROM part),
a AS (SELECT p_partkey, p_name, upper(array_to_string(list_transform(w, lambda x: left(x, 1)), '')) AS a FROM w) SELECT p_partkey, CASE WHEN length(a) BETWEEN 2 AND 8 AND NOT contains(p_name, a) THEN a END AS alias FROM a""")
def title_alias(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", T.title_alias(F.col("p_name")).alias("alias"))


@query("""WITH f AS (SELECT page_id, 'img/' || page_id || '.png' AS asset FROM pages), l AS (SELECT page_id, page_id || '.png' AS name, CASE WHEN page_id % 3 = 0 THEN 'table' ELSE 'image' END AS kind, page_id % 5 AS page FROM pages WHERE page_id % 2 = 0)
SELECT f.page_id, CASE WHEN kind = 'table' THEN 'table' ELSE 'figure' END AS modality, page FROM f LEFT JOIN l USING (page_id)""")
def asset_pairing(spark: SparkSession, d: str) -> DataFrame:
    pages, n = load(spark, d, "pages"), F.col("page_id").cast("string")
    figures = pages.select("page_id", F.concat(F.lit("img/"), n, F.lit(".png")).alias("asset"))
    layout = pages.where("page_id % 2 = 0").select(F.concat(F.lit("out/auto/"), n, F.lit(".png")).alias("path"), F.when(F.col("page_id") % 3 == 0, "table").otherwise("image").alias("kind"), (F.col("page_id") % 5).alias("page"))
    return S.pair_assets(figures, layout).select("page_id", "modality", "page")


@query(f"""WITH {CHUNK_SQL}, v AS (SELECT chunk_id, paper_id, CASE WHEN chunk_id % 7 = 3 THEN NULL ELSE 'img/' || chunk_id % 200 || '.png' END AS asset FROM chunk WHERE modality IN ('figure', 'table')),
a AS (SELECT 'img/' || page_id || '.png' AS asset, strlen(html) AS size FROM pages WHERE page_id % 5 <> 2),
j AS (SELECT v.*, size, coalesce(sum((coalesce(size, 1000000) <= 4000)::INT) OVER (PARTITION BY paper_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v LEFT JOIN a USING (asset))
SELECT chunk_id, CASE WHEN asset IS NULL THEN 'missing asset_path' WHEN size IS NULL THEN 'asset not found: ' || asset WHEN before >= 3 THEN 'max_images_per_paper=3 reached' WHEN size > 4000 THEN 'image exceeds max_image_bytes=4000' END AS reason FROM j""")
def visual_admission(spark: SparkSession, d: str) -> DataFrame:
    """Pages stand for image files; every source has three images at most."""
    n = F.col("chunk_id")
    rows = chunks(spark, d).withColumns({"asset": F.when(n % 7 != 3, F.concat(F.lit("img/"), (n % 200).cast("string"), F.lit(".png"))), "seq": n})
    files = load(spark, d, "pages").where("page_id % 5 <> 2").select(F.concat(F.lit("img/"), F.col("page_id").cast("string"), F.lit(".png")).alias("asset"), F.octet_length("html").alias("size"), F.sha2("html", 256).alias("digest"))
    return V.admitted(rows, files, 3, 4000).select("chunk_id", "reason")
