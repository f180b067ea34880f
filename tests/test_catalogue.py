"""The paper catalogues as a data source, on recorded responses."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corvine.sources import catalogue as C

ATOM = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/2101.00001v2</id><published>2021-01-01T00:00:00Z</published>
<title>A  Title
 of two lines</title><summary> Some text. </summary><author><name>Ann A</name></author><author><name>Bo B</name></author><arxiv:doi>10.1234/ABC</arxiv:doi><link title="pdf" href="http://arxiv.org/pdf/2101.00001v2"/></entry></feed>"""
WORK = {
    "id": "https://openalex.org/W1", "ids": {"doi": "https://doi.org/10.5555/XyZ"}, "title": " Work ", "publication_year": 2020, "language": "fr", "authorships": [{"author": {"display_name": "Cy C"}}, {"author": None}],
    "best_oa_location": {"pdf_url": None}, "primary_location": {"source": {"display_name": "Journal"}, "pdf_url": None}, "locations": [None, {"pdf_url": "http://x/w1.pdf"}], "open_access": {"oa_url": "http://x/w1.pdf"},
    "abstract_inverted_index": {"world": [1], "hello": [0, 2]},
}
PAPER = {"paperId": "abc", "title": "S", "authors": [{"name": "Di D"}, {}], "year": 2019, "externalIds": {"ArXiv": "1901.00002", "DOI": "10.1/Q"}, "openAccessPdf": {"url": "http://x/gone.pdf"}}


@pytest.fixture(scope="module")
def papers(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("responses")
    for url, body in {
        C.ARXIV + "2101.00001": ATOM.encode(), C.ARXIV + "9999.99999": b'<feed xmlns="http://www.w3.org/2005/Atom"/>', "http://arxiv.org/pdf/2101.00001v2": b"%PDF one",
        C.OPENALEX + "doi:10.5555/xyz": json.dumps(WORK).encode(), C.OPENALEX + "W2": json.dumps({"id": "https://openalex.org/W2"}).encode(), "http://x/w1.pdf": b"%PDF two",
        C.SCHOLAR + "arXiv:1901.00002" + C.SCHOLAR_FIELDS: json.dumps(PAPER).encode(), "http://x/My%20Paper.PDF": b"%PDF three",
    }.items():
        (folder / C.response_name(url)).write_bytes(body)
    C.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    def read(source: str, identifiers: list[str], **more):
        return spark.read.format("papers").options(source=source, identifiers=json.dumps(identifiers), responses=str(folder), content="true", **more).load()

    return read


def test_arxiv(papers):
    good, bad = sorted(papers("arxiv", ["arXiv:2101.00001v2", "9999.99999"], per_partition="1").collect(), key=lambda r: r["error"] or "")
    assert (good["paper_id"], good["title"], good["authors"], good["year"], good["venue"], good["doi"], good["version"], bytes(good["content"])) == ("arxiv:2101.00001", "A Title of two lines", ["Ann A", "Bo B"], 2021, "arXiv", "10.1234/abc", 2, b"%PDF one")
    assert "not found" in bad["error"] and bad["paper_id"] is None


def test_openalex_takes_the_first_pdf_there_is(papers):
    rows = {r["identifier"]: r for r in papers("openalex", ["doi:10.5555/XYZ", "https://openalex.org/W2", "doi:none", "W404"]).collect()}
    one, two = rows["doi:10.5555/XYZ"], rows["https://openalex.org/W2"]
    assert (one["paper_id"], one["title"], one["abstract"], one["lang"], one["urls"], bytes(one["content"])) == ("doi:10.5555/xyz", "Work", "hello world hello", None, ["http://x/w1.pdf", "https://openalex.org/W1"], b"%PDF two")
    assert (two["paper_id"], two["title"], two["authors"], two["content"], two["error"]) == ("openalex:W2", "", [], None, None)
    assert "invalid DOI" in rows["doi:none"]["error"] and "no recorded response" in rows["W404"]["error"]


def test_scholar_keeps_metadata_without_the_pdf(papers):
    row = papers("semantic_scholar", ["https://arxiv.org/abs/1901.00002v3"]).first()
    assert (row["paper_id"], row["authors"], row["content"], row["error"]) == ("arxiv:1901.00002", ["Di D"], None, None)


def test_links_and_files(papers, tmp_path):
    rows = {r["identifier"]: r for r in papers("url", ["http://x/My%20Paper.PDF", "http://x/page.html"]).collect()}
    assert (rows["http://x/My%20Paper.PDF"]["title"], rows["http://x/My%20Paper.PDF"]["paper_id"]) == ("My Paper", "sha1:" + hashlib.sha1(b"%PDF three").hexdigest())
    assert "no direct PDF" in rows["http://x/page.html"]["error"]
    (tmp_path / "a b.pdf").write_bytes(b"x")
    assert papers("local", [str(tmp_path / "a b.pdf"), str(tmp_path / "none.pdf")]).where("error is null").first()["title"] == "a b"


def test_filters_choose_what_is_fetched(spark, papers, tmp_path):
    asked = papers("arxiv", ["2101.00001", "9999.99999", "1111.11111"], pushdown="true", per_partition="1").where(F.col("identifier").isin("2101.00001", "1111.11111"))
    assert asked.rdd.getNumPartitions() == 2 and asked.where("error is null").count() == 1
    (tmp_path / "ids").write_text("2101.00001\n\n")
    assert spark.read.format("papers").options(source="arxiv", responses=str(tmp_path)).load(str(tmp_path / "ids")).first()["identifier"] == "2101.00001"


def test_fetched_papers_are_what_ingest_takes(spark, papers, tmp_path):
    from corvine.operators.ingest import Ingest
    from corvine.operators.versions import Versions

    into = Ingest(Versions(spark, str(tmp_path)), primary=lambda raw: "# Abstract\n\n" + raw.decode())
    report = into.run(papers("arxiv", ["2101.00001"]).where("error is null")).first()
    assert (report["paper_id"], report["status"], report["chunks"]) == ("arxiv:2101.00001", "done", 2)
