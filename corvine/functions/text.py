"""Column expressions over text: tokens, languages, cues, citations, identifiers."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The CJK ranges of the index, and those of selection, labels and languages.
CJK_INDEX = "一-鿿"
CJK_WIDE = "㐀-䶿一-鿿豈-﫿"
#: Characters that count as one token each (CJK with its marks and full-width forms).
CJK_TOKEN = "⺀-鿿豈-﫿＀-￯"

#: Cues of intents, in the order in which they are tried.
INTENT_CUES = {
    "zh": {
        "explore": ("有哪些进展", "有哪些新", "研究进展", "综述", "现状", "全景", "概览", "综观"),
        "reasoning": ("区别", "差异", "对比", "相比", "异同", "优劣", "哪个更", "为什么"),
        "factual": ("是什么", "是多少", "定义", "叫什么", "多少个", "准确率是", "什么时候"),
    },
    "en": {
        "explore": ("recent advances", "recent progress", "state of the art", "survey", "overview", "landscape", "what are the trends"),
        "reasoning": ("differ", "difference", "compare", "comparison", "versus", " vs ", "trade-off", "tradeoff", "why does", "why is"),
        "factual": ("what is", "what was", "how many", "how much", "definition of", "when was"),
    },
}
#: Fixed values: ``top_k`` and ``max_iter`` of an intent.
INTENT_TIERS = {"factual": (5, 1), "reasoning": (10, 2), "explore": (15, 3)}
#: Cues of modalities.
MODALITY_CUES = {
    "formula": ("formula", "equation", "latex", "derive", "derivation", "公式", "方程", "推导"),
    "figure": ("figure", "fig.", "diagram", "plot", "image", "图", "图像", "图表", "示意图"),
    "table": ("table", "tab.", "表", "表格", "对比表"),
}
#: Questions that ask for bibliographies.
REFERENCE_INTENT = (
    r"参考\s*文\s*献",
    r"文献\s*列表",
    r"被引\s*(?:工作|论文|文献)",
    r"引用(?:了)?(?:哪些|什么)(?:论文|文献|工作)",
    r"(?i)\bbibliograph(?:y|ies)\b",
    r"(?i)\breference\s+list\b",
    r"(?i)\bcitation\s+list\b",
    r"(?i)\bcited\s+(?:papers?|works?|references?)\b",
    r"(?i)\bwhich\s+(?:papers?|works?)\b[^?]*\bcited\b",
)
#: Names of reference sections, without blanks.
REFERENCE_SECTIONS = ("references", "bibliography", "参考文献")
#: Words of sections and titles that hint at good evidence.
SECTION_HINTS = ("abstract", "introduction", "method", "approach", "experiment", "evaluation", "result", "conclusion", "摘要", "引言", "绪论", "方法", "实验", "评估", "结果", "结论", "总结")
#: Forms of citations that name no chunk.
SUSPICIOUS = {
    "numeric": r"\[\d{1,3}\]",
    "numeric_wide": r"【\d{1,3}】",
    "author_year": r"\(\s*[A-Z][A-Za-zÀ-ſ.\-]+(?:\s+et\s+al\.?)?(?:\s*,)?\s*(?:18|19|20)\d{2}[a-z]?\s*\)",
    "author_year_wide": r"[（(]\s*[一-鿿]{1,4}\s*(?:等)?\s*[,，]?\s*(?:18|19|20)\d{2}[a-z]?\s*[)）]",
}
CHUNK_CITATION = r"\[chunk:([^\]\s]+)\]"


def any_of(text: Column, cues: Sequence[str]) -> Column:
    """True if one of the cues is a substring."""
    found = F.lit(False)
    for cue in cues:
        found = found | F.contains(text, F.lit(cue))
    return found


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def index_tokens(text: Column) -> Column:
    """Lower-case latin words and bigrams of CJK runs, as the sparse index has them."""
    return F.regexp_extract_all(F.lower(segment_cjk(text)), F.lit(rf"([a-z0-9_]+|[{CJK_INDEX}]+)"), F.lit(1))


_RUNS, _INNER, _TERMS = re.compile(f"([{CJK_INDEX}]+)"), re.compile(f"(?<=[{CJK_INDEX}])([{CJK_INDEX}])(?=[{CJK_INDEX}])"), re.compile(f"[a-z0-9_]+|[{CJK_INDEX}]+")
_TERM_BYTES = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789_" else 32 for b in range(256))


def segmented(text: str) -> str:
    """``segment_cjk`` of one text, but for the blanks."""
    if text.isascii() or not _RUNS.search(text):
        return text
    return _INNER.sub(r"\1 \1", _RUNS.sub(r" \1 ", text))


def index_terms(text: str | None) -> list[str]:
    """``index_tokens`` of one text, for operators that walk texts in Arrow batches."""
    text = text or ""
    if text.isascii() or not _RUNS.search(text):  # without CJK, terms are runs of some ASCII bytes
        return text.lower().encode("utf-8", "replace").translate(_TERM_BYTES).decode("ascii").split()
    return _TERMS.findall(segmented(text).lower())


def segment_cjk(text: Column) -> Column:
    """Runs of three or more CJK characters become overlapping pairs; blanks are collapsed."""
    spaced = F.regexp_replace(text, rf"([{CJK_INDEX}]+)", " $1 ")
    pairs = F.regexp_replace(spaced, rf"(?<=[{CJK_INDEX}])([{CJK_INDEX}])(?=[{CJK_INDEX}])", "$1 $1")
    return collapsed(pairs)


def match_atoms(query: Column, phrase_run: int = 6) -> Column:
    """The match expression of a query: quoted atoms joined by OR, CJK runs as phrases, bags or prefixes."""
    clean = F.regexp_replace(query, rf"[^\p{{L}}\p{{N}}_{CJK_INDEX}]+", " ")
    parts = F.regexp_extract_all(clean, F.lit(rf"([{CJK_INDEX}]+|[^{CJK_INDEX}\s]+)"), F.lit(1))

    def atom(part: Column) -> Column:
        quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
        bag = F.transform(F.sequence(F.lit(1), F.length(part) - 1), lambda i: quoted(F.substring(part, i, F.lit(2))))
        cjk = part.rlike(f"^[{CJK_INDEX}]")
        one = F.when(~cjk, quoted(part)).when(F.length(part) == 1, F.concat(quoted(part), F.lit("*"))).otherwise(quoted(segment_cjk(part)))
        return F.when(cjk & (F.length(part) > phrase_run), bag).otherwise(F.array(one))

    joined = F.array_join(F.flatten(F.transform(parts, atom)), " OR ")
    return F.when(F.size(parts) > 0, joined).otherwise('""')


def selection_tokens(text: Column) -> Column:
    """Distinct latin words and CJK pairs (single characters of runs of one)."""
    low = F.lower(text)
    runs = F.regexp_extract_all(low, F.lit(f"([{CJK_WIDE}]+)"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))))
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1)), pairs))


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's tokens that the text has; 0 for a query without tokens."""
    own = selection_tokens(query)
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, selection_tokens(text))) / F.size(own))


def query_language(query: Column) -> Column:
    return F.when(query.rlike(f"[{CJK_WIDE}]"), "zh").otherwise("en")


def document_language(text: Column) -> Column:
    """``zh`` from 20 CJK characters that are a twentieth of all letters, ``en`` from 50 latin ones, else null."""
    cjk = F.length(F.regexp_replace(text, f"[^{CJK_INDEX}]", ""))
    latin = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.when((cjk >= 20) & (cjk / (cjk + latin) >= 0.05), "zh").when(latin >= 50, "en")


def intent(question: Column) -> Column:
    """``explore``, ``reasoning`` or ``factual``; ``reasoning`` where no cue is found."""
    padded = F.concat(F.lit(" "), F.lower(question), F.lit(" "))
    out = {}
    for lang, hay in (("zh", question), ("en", padded)):
        out[lang] = F.lit("reasoning")
        for name in reversed(INTENT_CUES[lang]):
            out[lang] = F.when(any_of(hay, INTENT_CUES[lang][name]), name).otherwise(out[lang])
    return F.when(query_language(question) == "zh", out["zh"]).otherwise(out["en"])


def tier(name: Column, place: int) -> Column:
    out = F.lit(None).cast("int")
    for k, values in INTENT_TIERS.items():
        out = F.when(name == k, values[place]).otherwise(out)
    return out


def modalities(query: Column) -> Column:
    low = F.lower(query)
    return F.array_compact(F.array(*[F.when(any_of(low, cues), name) for name, cues in MODALITY_CUES.items()]))


def reference_intent(query: Column) -> Column:
    flat, found = collapsed(query), F.lit(False)
    for pattern in REFERENCE_INTENT:
        found = found | flat.rlike(pattern)
    return found


def is_reference(section: Column, flag: Column | None = None) -> Column:
    """The flag where it is known, else whether the section's name is one of references."""
    named = F.regexp_replace(F.lower(F.coalesce(section, F.lit(""))), r"\s+", "").isin(*REFERENCE_SECTIONS)
    return named if flag is None else F.coalesce(flag, named)


def section_hint(section: Column, title: Column | None = None) -> Column:
    low = F.lower(F.concat_ws(" ", section, title if title is not None else F.lit("")))
    return any_of(low, SECTION_HINTS).cast("int")


def token_estimate(text: Column) -> Column:
    """CJK characters count one each, four others count one; 1 at least."""
    cjk = F.length(F.regexp_replace(text, f"[^{CJK_TOKEN}]", ""))
    return F.greatest(F.lit(1), (cjk + F.floor((F.length(text) - cjk) / 4)).cast("int"))


def clip(text: Column, most: int = 6000) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.left(text, F.lit(most - 3))), F.lit("...")))


def with_context(text: Column, title: Column, section: Column, zh: Column | None = None) -> Column:
    """The text under a line that names title and section; empty ones are left out."""
    zh = F.lit(False) if zh is None else zh
    part = lambda en, cn, v: F.when(F.coalesce(v, F.lit("")) == "", "").otherwise(F.concat(F.lit("["), F.when(zh, cn).otherwise(en), v, F.lit("]")))
    head = F.trim(F.concat_ws(" ", part("Title: ", "标题: ", title), part("Section: ", "章节: ", section)))
    return F.when(head == "", text).otherwise(F.concat(head, F.lit("\n"), text))


def chunk_id(paper: Column, section: Column, kind: Column, ordinal: Column) -> Column:
    return F.left(F.sha1(F.concat_ws("::", paper, section.cast("string"), kind, ordinal.cast("string"))), F.lit(20))


def section_id(paper: Column, index: Column) -> Column:
    return F.left(F.sha1(F.concat_ws("::", paper, F.lit("sec"), index.cast("string"))), F.lit(16))


def title_norm(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", "")


def arxiv_id(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d{4}\.\d{4,5})(v\d+)?", 1), F.lit(""))


def doi(text: Column) -> Column:
    bare = F.regexp_replace(F.trim(text), r"(?i)^(https?://(dx\.)?doi\.org/|doi:)\s*", "")
    return F.when(bare.startswith("10."), F.lower(bare))


def safe_dirname(name: Column) -> Column:
    return F.translate(name, ":/", "__")


def uuid5(namespace: str, name: Column) -> Column:
    """A version 5 UUID, from the bits of SHA-1 over namespace and name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    kind = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), kind, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def cited_chunks(answer: Column) -> Column:
    return F.regexp_extract_all(answer, F.lit(CHUNK_CITATION), F.lit(1))


def valid_citations(answer: Column, retrieved: Column) -> Column:
    """Cited ids that were retrieved, in order, once each."""
    return F.array_distinct(F.filter(cited_chunks(answer), lambda c: F.array_contains(retrieved, c)))


def without_invalid(answer: Column, retrieved: Column) -> Column:
    wrong = F.array_distinct(F.filter(cited_chunks(answer), lambda c: ~F.array_contains(retrieved, c)))
    return F.aggregate(wrong, answer, lambda text, c: F.replace(text, F.concat(F.lit("[chunk:"), c, F.lit("]")), F.lit("")))


def suspicious(answer: Column, *kinds: str) -> Column:
    return F.flatten(F.array(*[F.regexp_extract_all(answer, F.lit(SUSPICIOUS[k]), F.lit(0)) for k in kinds]))


def without_suspicious(answer: Column) -> Column:
    for pattern in SUSPICIOUS.values():
        answer = F.regexp_replace(answer, pattern, "")
    answer = F.regexp_replace(answer, r"\s+([,.;:，。；：、])", "$1")
    return F.trim(F.regexp_replace(answer, r"\s{2,}", " "))


def title_acronyms(title: Column) -> Column:
    """Initials of two to four adjoining words, and acronyms written in the title."""
    words = F.filter(F.regexp_extract_all(title, F.lit(r"([A-Za-z][A-Za-z0-9]*)"), F.lit(1)), lambda w: ~F.lower(w).isin(*ACRONYM_STOPWORDS))
    one = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.transform(F.slice(words, i, F.lit(n)), lambda w: F.upper(F.left(w, F.lit(1)))), ""))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(one(2), one(3), one(4), F.regexp_extract_all(title, F.lit(r"\b([A-Z][A-Z0-9]{1,7})\b"), F.lit(1))))


#: Words that take no part in acronyms.
ACRONYM_STOPWORDS = ("a", "an", "and", "for", "in", "of", "on", "the", "to", "with")


def title_alias(title: Column) -> Column:
    """Initials of the title's head phrase: two to eight letters that the title does not have, else null."""
    head = F.get(F.split(title, r"\s*[:：–—]\s*|\s+-\s+"), 0)
    words = F.filter(F.regexp_extract_all(head, F.lit(r"([A-Za-z][A-Za-z0-9]*)"), F.lit(1)), lambda w: ~F.lower(w).isin(*ACRONYM_STOPWORDS))
    made = F.array_join(F.transform(words, lambda w: F.upper(F.left(w, F.lit(1)))), "")
    return F.when(F.length(made).between(2, 8) & ~F.contains(title, made), made)


def merged_variants(*variants: Column, most: int = 12) -> Column:
    """Query variants of several origins in order, once each but for case and blanks."""
    flat = F.filter(F.transform(F.flatten(F.array(*variants)), collapsed), lambda v: v != "")
    first = F.filter(flat, lambda v, i: ~F.exists(F.slice(flat, 1, i), lambda u: F.lower(u) == F.lower(v)))
    return F.slice(first, 1, most)
