"""Paper catalogues as a data source: ``spark.read.format("papers")`` gives a row of metadata, and the PDF if wanted, for each identifier.

Options: ``source`` (``arxiv``, ``openalex``, ``semantic_scholar``, ``url``, ``local``), ``identifiers`` (a JSON list) or ``load(path)`` of a file
with one a line, ``responses`` (a folder of recorded responses, named by the SHA-1 of their URLs; without it requests go out), ``content``
(``true``: fetch PDFs), ``per_partition`` (identifiers of a task), ``pushdown`` (``true``: filters on ``identifier`` choose what is
fetched; the session has to allow it by ``spark.sql.python.filterPushdown.enabled``).

A source is a function from an identifier and a getter to fields; what fails is a row with ``error``, so one paper stops no other.
A PDF that cannot be had leaves its metadata (``content`` null), but for links and files, which are nothing else.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = (
    "identifier string, paper_id string, title string, authors array<string>, year int, venue string, doi string, arxiv_id string, abstract string, lang string, "
    "urls array<string>, source string, version int, pdf_url string, content binary, error string"
)
#: Addresses and the fields that are asked for.
ARXIV = "http://export.arxiv.org/api/query?id_list="
OPENALEX = "https://api.openalex.org/works/"
SCHOLAR = "https://api.semanticscholar.org/graph/v1/paper/"
SCHOLAR_FIELDS = "?fields=title,authors,year,venue,abstract,externalIds,openAccessPdf"
ATOM = {"a": "http://www.w3.org/2005/Atom", "x": "http://arxiv.org/schemas/atom"}
TRIES, TIMEOUT = 3, 60

Getter = Callable[[str], bytes]


def plain_doi(text: str | None) -> str | None:
    found = re.search(r"10\.\d{4,9}/\S+", text or "")
    return found[0].rstrip(".,;)").lower() if found else None


def plain_arxiv(text: str) -> tuple[str | None, int | None]:
    """An arXiv id without its version, and the version."""
    found = re.search(r"(?:^|arxiv:|arxiv\.org/(?:abs|pdf)/)(\d{4}\.\d{4,5}|[a-z-]+(?:\.[A-Z]{2})?/\d{7})(?:v(\d+))?(?:\.pdf)?$", text.strip(), re.IGNORECASE)
    return (found[1], int(found[2]) if found[2] else None) if found else (None, None)


def first_id(arxiv: str | None, doi: str | None, other: str) -> str:
    return f"arxiv:{arxiv}" if arxiv else f"doi:{doi}" if doi else other


def unique(*urls: str | None) -> list[str]:
    """Addresses in their order, once each."""
    return list(dict.fromkeys(u for u in urls if u))


def from_arxiv(identifier: str, get: Getter) -> dict:
    own, version = plain_arxiv(identifier)
    own = own or identifier
    entry = ET.fromstring(get(ARXIV + urllib.parse.quote(own))).find("a:entry", ATOM)
    if entry is None or entry.find("a:title", ATOM) is None:
        raise ValueError(f"arxiv id not found: {own}")
    said = lambda path: (entry.findtext(path, namespaces=ATOM) or "").strip()
    pdf = next((link.get("href") for link in entry.findall("a:link", ATOM) if link.get("title") == "pdf"), None)
    published = said("a:published")[:4]
    return {
        "paper_id": f"arxiv:{own}", "arxiv_id": own, "version": version, "title": " ".join(said("a:title").split()), "authors": [a.findtext("a:name", namespaces=ATOM) for a in entry.findall("a:author", ATOM)],
        "year": int(published) if published.isdigit() else None, "venue": "arXiv", "doi": plain_doi(said("x:doi")), "abstract": said("a:summary"), "urls": unique(said("a:id"), pdf), "pdf_url": pdf,
    }


def words_by_place(inverted: dict | None) -> str | None:
    """A text from an index of words to their places."""
    if not inverted:
        return None
    return " ".join(word for _, word in sorted((place, word) for word, places in inverted.items() for place in places))


def from_openalex(identifier: str, get: Getter) -> dict:
    if identifier.lower().startswith("doi:"):
        known = plain_doi(identifier)
        if known is None:
            raise ValueError(f"invalid DOI identifier: {identifier}")
        url = f"{OPENALEX}doi:{known}"
    else:
        url = OPENALEX + identifier.removeprefix("https://openalex.org/")
    data = json.loads(get(url))
    doi = plain_doi((data.get("ids") or {}).get("doi"))
    places = [data.get("best_oa_location"), data.get("primary_location"), *(data.get("locations") or [])]
    pdf = next((p["pdf_url"] for p in places if p and p.get("pdf_url")), None)
    venue = ((data.get("primary_location") or {}).get("source") or {}).get("display_name")
    authors = [(a.get("author") or {}).get("display_name") for a in data.get("authorships") or []]
    return {
        "paper_id": first_id(None, doi, "openalex:" + data["id"].rsplit("/", 1)[-1]), "doi": doi, "title": (data.get("title") or "").strip(), "authors": [a for a in authors if a], "year": data.get("publication_year"),
        "venue": venue, "abstract": words_by_place(data.get("abstract_inverted_index")), "lang": data.get("language") if data.get("language") in ("zh", "en") else None,
        "urls": unique(pdf, (data.get("open_access") or {}).get("oa_url"), data.get("id")), "pdf_url": pdf,
    }


def from_scholar(identifier: str, get: Getter) -> dict:
    doi, (arxiv, _) = plain_doi(identifier), plain_arxiv(identifier)
    asked = f"DOI:{doi}" if doi else f"arXiv:{arxiv}" if arxiv else identifier.strip()
    data = json.loads(get(SCHOLAR + urllib.parse.quote(asked, safe=":/") + SCHOLAR_FIELDS))
    ids, pdf = data.get("externalIds") or {}, (data.get("openAccessPdf") or {}).get("url")
    return {
        "paper_id": first_id(ids.get("ArXiv"), plain_doi(ids.get("DOI")), f"s2:{data.get('paperId')}"), "doi": ids.get("DOI"), "arxiv_id": ids.get("ArXiv"), "title": (data.get("title") or "").strip(),
        "authors": [a["name"] for a in data.get("authors") or [] if a.get("name")], "year": data.get("year"), "venue": data.get("venue"), "abstract": data.get("abstract"),
        "urls": unique(pdf, f"https://www.semanticscholar.org/paper/{data.get('paperId')}"), "pdf_url": pdf,
    }


def from_url(identifier: str, get: Getter) -> dict:
    if not urllib.parse.urlparse(identifier).path.lower().endswith(".pdf"):
        raise ValueError(f"no direct PDF link: {identifier}")
    (arxiv, version), doi, content = plain_arxiv(identifier), plain_doi(identifier.removesuffix(".pdf")), get(identifier)
    name = urllib.parse.unquote(identifier.rsplit("/", 1)[-1])[: -len(".pdf")]
    return {"paper_id": first_id(arxiv, doi, "sha1:" + hashlib.sha1(content).hexdigest()), "arxiv_id": arxiv, "version": version, "doi": doi, "title": name, "authors": [], "urls": [identifier], "content": content}


def from_file(identifier: str, get: Getter) -> dict:
    path = Path(identifier.removeprefix("file://"))
    content = path.read_bytes()
    return {"paper_id": "sha1:" + hashlib.sha1(content).hexdigest(), "title": path.stem, "authors": [], "urls": [], "content": content}


#: The contract: an identifier and a getter of addresses to the fields of a paper.
SOURCES: dict[str, Callable[[str, Getter], dict]] = {"arxiv": from_arxiv, "openalex": from_openalex, "semantic_scholar": from_scholar, "url": from_url, "local": from_file}


def response_name(url: str) -> str:
    """The name of a recorded response."""
    return hashlib.sha1(url.encode()).hexdigest()


def recorded(folder: str) -> Getter:
    def get(url: str) -> bytes:
        path = Path(folder) / response_name(url)
        if not path.exists():
            raise OSError(f"no recorded response: {url}")
        return path.read_bytes()

    return get


def live(url: str) -> bytes:
    """A request, tried again with growing pauses."""
    for turn in range(TRIES):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "corvine"}), timeout=TIMEOUT) as reply:
                return reply.read()
        except OSError:
            if turn == TRIES - 1:
                raise
            time.sleep(2**turn)
    raise AssertionError


class Identifiers(InputPartition):
    """What one task fetches."""

    def __init__(self, values: list[str]) -> None:
        super().__init__(values)
        self.values = values


class CatalogueReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.only = options, None
        if options.get("source") not in SOURCES:
            raise ValueError(f"source must be one of {', '.join(SOURCES)}")

    def identifiers(self) -> list[str]:
        if "identifiers" in self.options:
            found = json.loads(self.options["identifiers"])
        elif "path" in self.options:
            found = Path(self.options["path"].removeprefix("file://")).read_text(encoding="utf-8").splitlines()
        else:
            raise ValueError("identifiers or a path are needed")
        found = [i.strip() for i in found if i and i.strip()]
        return [i for i in found if self.only is None or i in self.only]

    def partitions(self) -> Sequence[InputPartition]:
        all_, size = self.identifiers(), int(self.options.get("per_partition", 16))
        return [Identifiers(all_[a : a + size]) for a in range(0, len(all_), size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        get = recorded(self.options["responses"]) if "responses" in self.options else live
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        for identifier in getattr(partition, "values", []):
            row = {"identifier": identifier, "source": self.options["source"]}
            try:
                row |= SOURCES[self.options["source"]](identifier, get)
                if self.options.get("content", "").lower() == "true" and row.get("pdf_url") and not row.get("content"):
                    try:
                        row["content"] = get(row["pdf_url"])
                    except OSError:  # metadata are worth having alone
                        row["content"] = None
            except Exception as why:  # noqa: BLE001  whatever a catalogue may answer
                row["error"] = f"{type(why).__name__}: {why}"
            yield tuple(row.get(n) for n in names)


class PushedReader(CatalogueReader):
    """Filters on the identifier choose what is fetched; others are left to Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and tuple(f.attribute) == ("identifier",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = wanted if self.only is None else self.only & wanted
            else:
                yield f


class Catalogue(DataSource):
    @classmethod
    def name(cls) -> str:
        return "papers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return (PushedReader if self.options.get("pushdown", "").lower() == "true" else CatalogueReader)(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Catalogue)
