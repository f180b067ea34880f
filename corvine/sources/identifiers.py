"""Identifiers, locations and records of sources, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import any_of, arxiv_id, collapsed, doi

OPENALEX = "https://api.openalex.org/works/"
#: Modules whose absence means that a part of the parser is not installed; hosts of models; signs of no network; signs of no model.
FULL_MODULES = ("doclayout_yolo", "ultralytics", "rapid_table", "pyclipper", "shapely")
MODEL_HOSTS = ("api.github.com", "github.com", "huggingface.co")
OFFLINE = ("failed to resolve", "connectionerror", "max retries", "environment is not online")
NO_MODEL = ("not found", "no such file", "download")
#: What a failure's class advises.
HINTS = {
    "missing_cv2": "安装 MinerU 依赖: {python} -m pip install -e '.[mineru]'",
    "missing_mineru_full_extra": "安装完整 MinerU 依赖: {python} -m pip install -e '.[mineru]'",
    "missing_cli": "安装 magic-pdf, 或在配置中设置 mineru.cli。",
    "missing_models_or_offline": "MinerU 需要下载模型, 但当前 network/DNS 不可用。请提前下载模型并放入配置指定的模型目录。",
    "missing_models": "请检查 config/magic-pdf.json 中的 models-dir, 并完成 MinerU 模型下载。",
}
#: The lines of a metadata card.
CARD_PURPOSE = "Retrieve this record for questions about this paper as a whole, including its contribution, method, evaluation, datasets, experiments, results, limitations, figures, tables, and formulas."
CARD_ZH_HEADER, CARD_ZH_PURPOSE = "论文元数据记录。", "当问题涉及这篇论文整体时检索本记录, 包括其贡献、方法、评测、数据集、实验、结果、局限、图、表与公式。"
CARD_ZH = (("title", "标题"), ("paper_id", "论文 id"), ("arxiv_id", "arXiv id"), ("aliases", "标题别名与缩写"), ("authors", "作者"), ("year", "年份"), ("venue", "发表于"), ("doi", "DOI"), ("abstract", "摘要"))
CARD_AUTHORS = 12
CARD = (("title", "Title"), ("paper_id", "Paper id"), ("arxiv_id", "arXiv id"), ("aliases", "Title aliases and acronyms"), ("authors", "Authors"), ("year", "Year"), ("venue", "Venue"), ("doi", "DOI"), ("abstract", "Abstract"))


def openalex_request(identifier: Column) -> Column:
    """The request for a DOI, a catalogue URL or a bare id."""
    known = doi(identifier)
    last = F.element_at(F.split(F.trim(identifier), "/"), -1)
    return F.when(known.isNotNull(), F.concat(F.lit(OPENALEX + "doi:"), known)).otherwise(F.concat(F.lit(OPENALEX), last))


def scholar_id(identifier: Column) -> Column:
    """``arXiv:`` ids without version, ``DOI:`` ids, and others as they are."""
    known = doi(identifier)
    arxiv = F.when(F.lower(identifier).startswith("arxiv:") | identifier.rlike(r"^\d{4}\.\d{4,5}(v\d+)?$") | F.contains(identifier, F.lit("arxiv.org/")), arxiv_id(identifier))
    return F.when(known.isNotNull(), F.concat(F.lit("DOI:"), known)).when(arxiv.isNotNull(), F.concat(F.lit("arXiv:"), arxiv)).otherwise(F.trim(identifier))


def first_pdf(best: Column, primary: Column, others: Column) -> Column:
    return F.coalesce(best, primary, F.get(F.filter(others, lambda x: x.isNotNull()), 0))


def paper_id(arxiv: Column, doi_: Column, content_sha1: Column) -> Column:
    return F.coalesce(F.concat(F.lit("arxiv:"), arxiv), F.concat(F.lit("doi:"), doi_), F.concat(F.lit("sha1:"), content_sha1))


def is_meaningful(markdown: Column, marker: str = r"(?i)<!--\s*page\s+\d+\s*-->") -> Column:
    return F.trim(F.regexp_replace(markdown, marker, "")) != ""


def failure(message: Column, python: str = "python") -> Column:
    """``struct(category, hint)`` of what a parser said when it failed; the first class that fits, else unknown without a hint."""
    low = F.lower(F.coalesce(message, F.lit("")))
    without = lambda *modules: any_of(low, [f"no module named {q}{m}{q}" for m in modules for q in ("'", "")])
    classes = (
        ("missing_cv2", without("cv2")),
        ("missing_mineru_full_extra", without(*FULL_MODULES)),
        ("missing_cli", F.contains(low, F.lit("no such file or directory")) & any_of(low, ("magic-pdf", "mineru"))),
        ("missing_models_or_offline", F.contains(low, F.lit("missing_models_or_offline")) | any_of(low, MODEL_HOSTS) & any_of(low, OFFLINE)),
        ("missing_models", F.contains(low, F.lit("model")) & any_of(low, NO_MODEL)),
    )
    out = F.struct(F.lit("unknown").alias("category"), F.lit("").alias("hint"))
    for name, fits in reversed(classes):
        out = F.when(fits, F.struct(F.lit(name).alias("category"), F.lit(HINTS[name].format(python=python)).alias("hint"))).otherwise(out)
    return out


def metadata_card(header: str = "Paper metadata record.", **fields: Column) -> Column:
    """A card's text; fields that are null have no line, the abstract's blanks are collapsed."""
    fields = fields | ({"abstract": collapsed(fields["abstract"])} if "abstract" in fields else {})
    lines = [F.concat(F.lit(f"{label}: "), fields[k].cast("string")) for k, label in CARD if k in fields]
    return F.concat_ws("\n", F.lit(header), *lines)


def paper_card(zh: Column, **fields: Column) -> Column:
    """The whole card in the paper's language: header, purpose, and a line for each field that is there; lists are joined, 12 authors at most."""
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", "))
    fields = fields | {"aliases": listed(fields["aliases"]), "authors": listed(F.slice(fields["authors"], 1, CARD_AUTHORS)), "abstract": collapsed(fields["abstract"])}
    zh = F.coalesce(zh, F.lit(False))
    full = {k: F.when(v.cast("string") != "", v.cast("string")) for k, v in fields.items()} | {"title": F.coalesce(fields["title"], F.lit(""))}
    lines = [F.concat(F.when(zh, own).otherwise(label), F.lit(": "), full[k]) for (k, label), (_, own) in zip(CARD, CARD_ZH, strict=True)]
    return F.concat_ws("\n", F.when(zh, CARD_ZH_HEADER).otherwise("Paper metadata record."), F.when(zh, CARD_ZH_PURPOSE).otherwise(CARD_PURPOSE), *lines)


def encode_inverted(texts: Column) -> Column:
    """A map of words to their places, of texts as arrays of words; inside the row, by one sort of the words."""
    places = F.sort_array(F.flatten(F.transform(texts, lambda t: F.transform(t, lambda w, i: F.struct(w.alias("word"), i.alias("at"))))))

    def entries(placed: Column) -> Column:
        word = lambda i: F.get(placed, i)["word"]
        first = F.filter(F.transform(placed, lambda _, i: i), lambda i: (i == 0) | (word(i) != word(i - 1)))
        own = lambda heads: F.transform(heads, lambda h, k: F.struct(word(h).alias("word"), F.transform(F.slice(placed, h + 1, F.coalesce(F.get(heads, k + 1), F.size(placed)) - h), lambda p: p["at"]).alias("at")))
        return F.get(F.transform(F.array(first), own), F.lit(0))

    # arrays of one element bind a value, so that it is made once and not at each of its uses
    return F.map_from_entries(F.get(F.transform(F.array(places), entries), F.lit(0)))


def decode_inverted(inverted: Column) -> Column:
    """A text from a map of words to their places."""
    places = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(places), lambda x: x["word"]), " ")
