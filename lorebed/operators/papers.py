"""Structure of long documents: section headers, their hierarchy, and the parts of a paper."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NUMBERED = re.compile(r"(?m)^[ \t]*(\d+(?:\.\d+)+)[ \t]+([A-Z][A-Za-z][^\n]{2,80})[ \t]*$")
_SPLIT = re.compile(r"(?m)^[ \t]*(\d+(?:\.\d+)*)[ \t]*\n[ \t]*([A-Z][A-Za-z][^\n]{2,200})")
_NAMED = re.compile(r"(?mi)^[ \t]*((?:Section|Chapter|Part|Appendix)\s+[\dA-Z]+(?:\.\d+)*)[:.\s]+([A-Z][^\n]{3,80})?[ \t]*$")
_LISTED = re.compile(r"\.{3,}\s*\d+\s*$|\.{10,}")
_PAGE_MARK = re.compile(r"(?i)^(?:\d{4}\s+[A-Z]{6,}|page\s*\||\d+\s*$)")
HIGHEST, TITLE = 50, 80


def headers(text: str) -> list[tuple[int, str, str, int]]:
    """(position, number, title, level) of headers, in order; lines of a table of contents and page marks are none."""
    found: dict[int, tuple[int, str, str, int]] = {}
    for pattern in (_NUMBERED, _SPLIT, _NAMED):
        for m in pattern.finditer(text):
            number, title = m[1].strip(), (m[2] or "").strip()
            if _LISTED.search(title) or _PAGE_MARK.match(f"{number} {title}"):
                continue
            if pattern is _SPLIT and "." not in number and int(number) > HIGHEST:
                continue
            found.setdefault(m.start(), (m.start(), number, title[:TITLE].strip(), number.count(".") + 1))
    return [found[k] for k in sorted(found)]


def sections(pages: list[str], least: int = 200) -> list[tuple[str, str, int, int, str]]:
    """(breadcrumb, title, first page, last page, text) of each section of at least ``least`` characters.

    The breadcrumb is the stack of headers above: a header closes those of its own level and deeper.
    """
    text, starts = "", []
    for page in pages:
        starts.append(len(text))
        text += (page or "") + "\n"
    marks = headers(text)
    page_at = lambda pos: sum(s <= pos for s in starts)
    out, stack = [], []
    for k, (pos, number, title, level) in enumerate(marks):
        end = marks[k + 1][0] if k + 1 < len(marks) else len(text)
        stack = [s for s in stack if s[0] < level] + [(level, f"{number} {title}".strip())]
        body = text[pos:end].strip()
        if len(body) >= least:
            out.append((" > ".join(s[1] for s in stack), title, page_at(pos), page_at(max(pos, end - 1)), body))
    return out


def split_sections(docs: DataFrame, key: str = "doc_id", least: int = 200) -> DataFrame:
    """Sections of documents with an array of pages: key, pos, breadcrumb, title, first_page, last_page, text."""
    kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
    names = ["pos", "breadcrumb", "title", "first_page", "last_page", "text"]

    def run(batches):
        for batch in batches:
            rows = [(k, i, *s) for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, s in enumerate(sections(p or [], least))]
            if rows:
                cols = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), [batch.column(0).type, *kinds], strict=True)]
                yield pa.record_batch(cols, names=[key, *names])

    schema = f"`{key}` {dict(docs.dtypes)[key]}, pos int, breadcrumb string, title string, first_page int, last_page int, text string"
    return docs.select(key, "pages").mapInArrow(run, schema)


def parts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Title, abstract and keywords of papers (text): the title is the first line of fair length that is no running head."""
    lines = F.transform(F.slice(F.split("text", "\n"), 1, 10), lambda x: F.trim(x))
    heads = r"(?i)page|vol\.|volume|journal|copyright|doi:"
    title = F.get(F.filter(lines, lambda x: (F.length(x) > 10) & (F.length(x) < 200) & ~x.rlike(heads)), F.lit(0))
    after = r"(?=\n\s*(?:introduction|keywords|1\.|1\s|background))"
    found = [F.regexp_extract("text", rf"(?is){word}[:\s]*\n?(.*?){after}", 1) for word in ("abstract", "summary")]
    clean = [F.trim(F.regexp_replace(f, r"\s+", " ")) for f in found]
    abstract = F.coalesce(*[F.when(F.length(c) > 100, F.left(c, F.lit(2000))) for c in clean], F.lit(""))
    words = F.split(F.regexp_extract("text", r"(?i)keywords?[: \t]*([^\n]+)", 1), "[,;]")
    keywords = F.slice(F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: w != ""), 1, 10)
    return docs.select(key, F.coalesce(title, F.lit("")).alias("title"), abstract.alias("abstract"), keywords.alias("keywords"))
