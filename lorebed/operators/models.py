"""Models behind an interface: embedding and translation run where the data is, one model a worker, batch by batch.

No model is shipped. ``Hashing`` is a stand-in that needs none: deterministic vectors from hashed words.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from html.parser import HTMLParser
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST, BATCH = 50_000, 64
LONGEST_TRANSLATED = 500  # characters of a text that the model reads
#: What of a page isn't translated (fixed values).
SKIPPED_TAGS = ("script", "style", "code", "pre", "kbd", "var", "noscript", "cite", "sup", "sub", "nav", "footer", "header")
SKIPPED_CLASSES = (
    "reference", "references", "reflist", "refbegin", "mw-editsection", "mw-headline-anchor", "cite-bracket", "toc", "catlinks",
    "navbox", "sistersitebox", "mbox", "ambox", "metadata", "noprint", "plainlinks", "infobox", "sidebar", "vertical-navbox",
)
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class Hashing:
    """Unit vectors of signed word hashes."""

    dimension: int = 64

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), dtype=np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[h % self.dimension] += 1 if h >> 31 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)


def embed(docs: DataFrame, make: Callable[[], Embedder], key: str = "doc_id", text: str = "text", tries: int = 3) -> DataFrame:
    """key and embedding of each document; a batch that fails is tried again, then text by text; what still fails is a zero vector."""

    def run(batches):
        model = make()

        def once(texts: list[str]) -> np.ndarray:
            for k in range(tries):
                try:
                    return model.embed(texts)
                except Exception:
                    if k == tries - 1 and len(texts) == 1:
                        return np.zeros((1, model.dimension), dtype=np.float32)
            return np.concatenate([once([t]) for t in texts])

        for batch in batches:
            texts = [(t or "")[:LONGEST] for t in batch.column(1).to_pylist()]
            found = [once(texts[i : i + BATCH]) for i in range(0, len(texts), BATCH)]
            flat = np.concatenate(found) if found else np.zeros((0, 1), dtype=np.float32)
            yield pa.record_batch([batch.column(0), pa.array(list(flat.astype(np.float32)), type=pa.list_(pa.float32()))], names=[key, "embedding"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, embedding array<float>")


def on_devices(make: Callable[[int], Embedder], devices: int) -> Callable[[], Embedder]:
    """A model for each task on one of several devices, dealt by the task's number."""

    def made() -> Embedder:
        return make(TaskContext.get().partitionId() % devices)

    return made


def embed_missing(docs: DataFrame, vectors: DataFrame, make: Callable[[], Embedder], dimension: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Vectors (key, embedding) of one dimension for all documents: those that are there and sound, and the others embedded anew."""
    sound = vectors.filter((F.size("embedding") == dimension) & F.exists("embedding", lambda x: x != 0)).select(key, "embedding")
    left = docs.join(sound.select(key), key, "left_anti")
    return sound.join(docs.select(key), key, "left_semi").unionByName(embed(left, make, key, text))


def translate(texts: DataFrame, cache: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], column: str = "text") -> DataFrame:
    """Add ``translated``: from the cache (source_text, translated) where it has a text, else by the model, each text once."""
    wanted = texts.select(F.col(column).alias("source_text")).distinct()
    fresh = wanted.join(cache, "source_text", "left_anti").filter(should_translate(F.col("source_text")))

    def run(batches):
        model = make()
        for batch in batches:
            own = [x[:LONGEST_TRANSLATED] for x in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(model(own), type=pa.string())], names=["source_text", "translated"])

    known = cache.select("source_text", "translated").unionByName(fresh.mapInArrow(run, "source_text string, translated string"))
    joined = texts.join(known.withColumnRenamed("source_text", column), column, "left")
    return joined.withColumn("translated", F.coalesce("translated", F.col(column)))


class _Nodes(HTMLParser):
    """A page's markup as it is, with the texts between that may be translated marked."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=False)
        self.parts: list[tuple[str, bool]] = []  # source; whether it is a text to translate
        self._open: list[tuple[str, bool]] = []  # tag; whether it or one around it is skipped
        self._at = 0
        self._page, self._starts = page, [0, *(m.end() for m in re.finditer("\n", page))]
        self.feed(page)
        self.close()
        self._mark(len(page), not self._skipped() and "<" not in page[self._at :])

    def _here(self) -> int:
        line, column = self.getpos()
        return self._starts[line - 1] + column

    def _mark(self, upto: int, text: bool) -> None:
        if upto > self._at:
            self.parts.append((self._page[self._at : upto], text))
            self._at = upto

    def handle_starttag(self, tag, attrs):
        self._mark(self._here(), not self._skipped())
        names = (dict(attrs).get("class") or "").split()
        if tag not in VOID:
            self._open.append((tag, self._skipped() or tag in SKIPPED_TAGS or any(x in SKIPPED_CLASSES for x in names)))
        self._mark(self._here() + len(self.get_starttag_text()), False)

    def handle_startendtag(self, tag, attrs):
        self._mark(self._here(), not self._skipped())
        self._mark(self._here() + len(self.get_starttag_text()), False)

    def handle_endtag(self, tag):
        self._mark(self._here(), not self._skipped())
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == tag:
                del self._open[k:]
                break
        self._mark(self._page.find(">", self._here()) + 1, False)

    def handle_comment(self, data):
        self._mark(self._here(), not self._skipped())
        self._mark(self._here() + len(data) + 7, False)

    def handle_decl(self, decl):
        self._mark(self._here() + len(decl) + 3, False)

    def _skipped(self) -> bool:
        return bool(self._open) and self._open[-1][1]


def worth_translating(text: str) -> bool:
    """``should_translate`` for one text."""
    clean = text.strip()
    letters = sum(c.isalpha() for c in clean)
    return len(clean) > 3 and 2 * letters >= len(clean) and len(clean.split()) >= 2 and not re.match(r"v?\d+([./-]\d+)+$", clean)


def translated_page(page: str, model: Callable[[list[str]], list[str]]) -> str:
    """A page with the texts worth it translated in batches; markup, code, references and navigation stay as they are."""
    parts = _Nodes(page).parts
    at = [k for k, (x, text) in enumerate(parts) if text and worth_translating(html.unescape(x))]
    out = [x for x, _ in parts]
    for i in range(0, len(at), BATCH):
        own = [html.unescape(out[k]).strip()[:LONGEST_TRANSLATED] for k in at[i : i + BATCH]]
        for k, text in zip(at[i : i + BATCH], model(own), strict=True):
            out[k] = html.escape(text, quote=False)
    return "".join(out)


def translate_pages(pages: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], key: str = "page_id") -> DataFrame:
    """key and translated html of each page."""

    def run(batches):
        model = make()
        for batch in batches:
            done = [None if x is None else translated_page(x, model) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(done, type=pa.string())], names=[key, "html"])

    return pages.select(key, "html").mapInArrow(run, f"`{key}` {dict(pages.dtypes)[key]}, html string")


def should_translate(text: Column) -> Column:
    """Whether a text is worth it: longer than 3, half letters, two words, no date or version."""
    clean = F.trim(text)
    letters = F.regexp_count(clean, F.lit(r"\p{L}"))
    return (F.length(clean) > 3) & (letters * 2 >= F.length(clean)) & clean.rlike(r"\S\s+\S") & ~clean.rlike(r"^v?\d+([./-]\d+)+$")
