"""Text of HTML pages, and captions in SRT and VTT."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import code_seconds

#: Elements without text of the page (fixed values).
SKIPPED = frozenset({"script", "style", "nav", "header", "footer", "aside", "iframe", "noscript"})
_CODES = re.compile(r"(?P<a>[\d:.,]+)\s*-->\s*(?P<b>[\d:.,]+)")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip.append(tag)

    def handle_endtag(self, tag):
        if tag in self.skip:
            while self.skip.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.skip and (words := data.split()):
            self.parts.append(" ".join(words))


def page_text(source: str | None) -> str:
    """All text outside of skipped elements, text nodes joined by a blank."""
    reader = _Text()
    reader.feed(source or "")
    reader.close()
    return " ".join(reader.parts)


def extract_text(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """key, text and char_count of each page, Arrow batch by batch."""

    def run(batches):
        for batch in batches:
            texts = [page_text(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int32())], names=[key, "text", "char_count"])

    return pages.select(key, column).mapInArrow(run, f"`{key}` {dict(pages.dtypes)[key]}, text string, char_count int")


def srt_segments(files: DataFrame) -> DataFrame:
    """Segments of SRT texts (video_id, text): blocks between blank lines, each with a line of time codes."""
    blocks = files.select("video_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), r"\n\s*\n")).alias("pos", "block"))
    codes = r"([\d:.,]+)\s*-->\s*([\d:.,]+)[^\n]*\n?"
    timed = blocks.filter(F.col("block").rlike(codes))
    body = F.trim(F.regexp_replace(F.regexp_extract("block", r"(?s)-->[^\n]*\n(.*)", 1), r"\s+", " "))
    return timed.select(
        "video_id",
        "pos",
        code_seconds(F.regexp_extract("block", codes, 1)).alias("start_sec"),
        code_seconds(F.regexp_extract("block", codes, 2)).alias("end_sec"),
        body.alias("text"),
    ).filter("text <> ''")


def vtt_cues(text: str) -> list[tuple[str, str, str]]:
    """(start, end, text) of a VTT file, line by line; headers, notes, styles and cue names are passed over."""
    cues, codes, lines = [], None, []
    for line in [*text.replace("\r\n", "\n").replace("\r", "\n").split("\n"), ""]:
        line = line.strip()
        found = _CODES.search(line)
        if found or not line:
            if codes and lines:
                cues.append((*codes, " ".join(lines)))
            codes, lines = ((found["a"], found["b"]) if found else None), []
        elif codes:
            lines.append(unescape(re.sub(r"<[^>]*>", "", line)))
    return cues


def vtt_segments(files: DataFrame) -> DataFrame:
    """Segments of VTT texts (video_id, text)."""

    def run(batches):
        for batch in batches:
            rows = [(v, i, *c) for v, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, c in enumerate(vtt_cues(t or ""))]
            if rows:
                cols = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()], strict=True)]
                yield pa.record_batch(cols, names=["video_id", "pos", "a", "b", "text"])

    cues = files.select(F.col("video_id").cast("string"), "text").mapInArrow(run, "video_id string, pos int, a string, b string, text string")
    return cues.select("video_id", "pos", code_seconds(F.col("a")).alias("start_sec"), code_seconds(F.col("b")).alias("end_sec"), "text").filter("text <> ''")
