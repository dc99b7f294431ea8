"""From a question to ranked articles: sources, search, re-ranking, quality and diversity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import search
from ..operators.classify import doc_type


def _typed(hits: DataFrame) -> DataFrame:
    """Hits with their document type: it follows from what a hit holds, so the corpus is scanned once."""
    return hits.withColumns({"doc_type": doc_type(F.col("title"), F.col("content")), "url": F.lit(None).cast("string")})


def answer(docs: DataFrame, question: str, sources: list[str] | None = None, preferred: str | None = None) -> DataFrame:
    """The articles that a question gets by keyword search, best first."""
    hits = search.keyword_top(docs, question, search.CANDIDATES, sources)
    return search.prepare(_typed(hits), None, question, preferred or search.intent_text(question))


def answer_by_vector(docs: DataFrame, vectors: DataFrame, asked: list[float], question: str, metric: str = "l2") -> DataFrame:
    """The same by vector search; ``vectors``: id, embedding; ids are doc_ids."""
    found = search.vector_top(vectors.select("id", "embedding"), asked, search.CANDIDATES, metric)
    near = found.select(F.col("id").alias("doc_id"), "score", "pos")
    hits = docs.join(F.broadcast(near), "doc_id")  # CANDIDATES rows
    return search.prepare(_typed(hits), None, question, search.intent_text(question))


def respond(question: str, hits: DataFrame, models: list[Callable[[str, str], Iterator[str]]]) -> Iterator[str]:
    """An answer in parts: of the first model that gives any for the question and the articles, else the list of titles.

    A model that fails before its first part is passed over; one that fails later has had its say.
    """
    context = search.context_block(hits).first()[0] or ""  # a few articles
    for model in models:
        given = False
        try:
            for part in model(question, context):
                if part:
                    given = True
                    yield part
        except Exception:
            if given:
                return
        if given:
            return
    yield search.simple_response(hits).first()[0] or ""
