"""Texts cut into pieces: pages with overlap, sections, smart chunks, halves.

What a piece starts with depends on the piece before, so these are folds over one document. Each document is folded in
one row (a generator over its own text or pages), so nothing is shuffled and hot documents need no group of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE_SIZE, PAGE_OVERLAP = 4000, 300
SMART_SIZE, SMART_OVERLAP, SMART_LEAST = 4000, 200, 100
_HEADER = re.compile(r"^(?:#{1,6}\s+\S.*|\d+(?:\.\d+)*\.?\s+[A-Z].{2,80}|[A-Z][A-Z0-9 ,:&-]{4,80})$", re.MULTILINE)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def page_chunks(pages: list[str], size: int = PAGE_SIZE, overlap: int = PAGE_OVERLAP) -> Iterator[tuple[str, int, int]]:
    """(text, first page, last page): pages are added until the next would pass ``size``; a chunk starts with the end of the last."""
    text, first = "", 1
    for number, page in enumerate(pages, 1):
        if text and len(text) + len(page) > size:
            yield text, first, number - 1
            text, first = (text[-overlap:] if len(text) > overlap else ""), number
        text += page + "\n"
    if text.strip():
        yield text, first, len(pages)


def _pack(parts: list[str], glue: str, size: int) -> Iterator[str]:
    """Parts joined while they fit."""
    held = ""
    for part in parts:
        if held and len(held) + len(glue) + len(part) > size:
            yield held
            held = part
        else:
            held = held + glue + part if held else part
    if held:
        yield held


def smart_chunks(text: str, size: int = SMART_SIZE, overlap: int = SMART_OVERLAP, least: int = SMART_LEAST) -> list[str]:
    """Cut at headers, then at paragraphs, then at sentences, and only then in words; short pieces go.

    A chunk that continues a section begins with the end of the chunk before.
    """
    starts = [m.start() for m in _HEADER.finditer(text)]
    sections = [text[a:b] for a, b in zip([0, *starts], [*starts, len(text)], strict=True) if text[a:b].strip()]
    out: list[str] = []
    for section in sections:
        pieces: list[str] = []
        for paragraph in re.split(r"\n\s*\n", section):
            if len(paragraph) <= size:
                pieces.append(paragraph)
                continue
            for sentence in _SENTENCE.split(paragraph):
                pieces += [sentence[i : i + size] for i in range(0, len(sentence), size)]
        before = ""
        for chunk in _pack([p.strip() for p in pieces if p.strip()], "\n\n", size):
            out.append(before[-overlap:] + " " + chunk if before else chunk)
            before = chunk
    return [c for c in out if len(c) > least]


def halve(text: str, longest: int, levels: int = 3, reach: int = 500) -> list[str]:
    """Halves, at the sentence end nearest to the middle within ``reach``, until each is short or ``levels`` are used."""
    if len(text) <= longest or not levels:
        return [text]
    middle = len(text) // 2
    near = [m.end() for m in re.finditer(r"[.!?]\s", text[max(0, middle - reach) : middle + reach])]
    at = min((max(0, middle - reach) + e for e in near), key=lambda e: abs(e - middle), default=middle)
    return halve(text[:at], longest, levels - 1, reach) + halve(text[at:], longest, levels - 1, reach)


def _rows(docs: DataFrame, key: str, columns: list[str], cut, names: str) -> DataFrame:
    """Apply ``cut`` to each row's columns and number what it yields."""
    schema = f"`{key}` {dict(docs.dtypes)[key]}, chunk int, total int, {names}"

    def run(batches):
        for batch in batches:
            out: list[list] = []
            for row in batch.to_pylist():
                found = [x if isinstance(x, tuple) else (x,) for x in cut(*[row[c] for c in columns])]
                out += [[row[key], i, len(found), *x] for i, x in enumerate(found)]
            if out:
                kinds = [batch.schema.field(key).type, pa.int32(), pa.int32(), *types]
                arrays = [pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.record_batch(arrays, names=heads)

    heads = [key, "chunk", "total", *[x.split()[0] for x in names.split(", ")]]
    types = [pa.string() if x.split()[1] == "string" else pa.int32() for x in names.split(", ")]
    return docs.select(key, *columns).mapInArrow(run, schema)


def chunk_pages(docs: DataFrame, key: str = "doc_id", size: int = PAGE_SIZE, overlap: int = PAGE_OVERLAP) -> DataFrame:
    """Chunks of documents with an array of pages: key, chunk, total, text, first_page, last_page."""
    cut = lambda pages: list(page_chunks([p or "" for p in pages or []], size, overlap))
    return _rows(docs, key, ["pages"], cut, "text string, first_page int, last_page int")


def chunk_text(docs: DataFrame, key: str = "doc_id", size: int = SMART_SIZE, overlap: int = SMART_OVERLAP) -> DataFrame:
    """Smart chunks of documents with a text: key, chunk, total, text."""
    return _rows(docs, key, ["text"], lambda t: smart_chunks(t or "", size, overlap), "text string")


def halves(docs: DataFrame, key: str = "doc_id", longest: int = 32_000) -> DataFrame:
    """Texts too long for a model, halved: key, chunk, total, text."""
    return _rows(docs, key, ["text"], lambda t: halve(t or "", longest), "text string")


def section_bounds(headers: DataFrame, last_page: str = "n_pages") -> DataFrame:
    """Headers (doc_id, pos, page, title, n_pages) with the page on which each section ends: the next header's, or the last."""
    order = Window.partitionBy("doc_id").orderBy("page", "pos")
    return headers.withColumn("end_page", F.coalesce(F.lead("page").over(order), F.col(last_page)))


def page_groups(pages: DataFrame, n: int = 3) -> DataFrame:
    """Pages (doc_id, page, text) in groups of ``n``, texts joined in order."""
    order = Window.partitionBy("doc_id").orderBy("page")
    numbered = pages.withColumn("grp", F.floor((F.row_number().over(order) - 1) / n).cast("int"))
    texts = F.sort_array(F.collect_list(F.struct("page", "text")))
    return numbered.groupBy("doc_id", "grp").agg(
        F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.array_join(F.transform(texts, lambda t: t["text"]), "\n").alias("text")
    )
