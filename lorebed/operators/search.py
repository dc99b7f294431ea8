"""Retrieval: keyword and vector top-k, then re-ranking, quality and diversity cuts, and what is shown of the hits.

Hits carry ``pos`` (their rank so far) because a DataFrame has no order of its own. Windows without a partition stand only
over hits already cut to a top-k, a few dozen rows at any corpus size.
"""

from __future__ import annotations

import re
from difflib import get_close_matches

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vec
from ..functions import web

CANDIDATES, RESULTS, PER_SOURCE = 15, 5, 2
BOOST, PENALTY = 0.15, 0.05
GENERIC_FLOOR, FLOOR, HOPELESS = 0.33, 0.18, 0.12

#: Substrings that tell what kind of document a question wants; the first kind with a hit decides (fixed values).
INTENTS = {
    "academic": [
        "research", "study", "studies", "paper", "papers", "academic", "scientific", "journal", "peer-reviewed", "scholarly",
        "literature", "evidence", "data shows", "findings", "experiment", "methodology",
    ],
    "product": [
        "buy", "purchase", "where can i get", "where to buy", "product", "manufacturer", "vendor", "commercial", "ready-made",
        "pre-built", "store", "shop", "order", "price", "cost of buying",
    ],
    "article": [
        "what is", "explain", "tell me about", "information about", "article about", "learn about", "overview of", "background on",
        "history of", "science behind", "how does it work", "why does",
    ],
    "guide": [
        "how to", "how do i", "build", "make", "construct", "diy", "instructions", "step by step", "tutorial", "guide", "plans",
    ],
}
#: Questions that only ask for help (fixed values).
GENERIC_PHRASES = (
    "help", "help me", "i need help", "need help", "please help", "emergency", "i need assistance", "assist me", "what do i do",
    "can you help",
)
GENERIC_WORDS = ("help", "emergency", "assistance")


def intent(message: Column) -> Column:
    low = F.lower(message)
    found = None
    for kind, words in INTENTS.items():
        hit = tx.any_contains(low, words)
        found = F.when(hit, kind) if found is None else found.when(hit, kind)
    return found


def is_generic(message: Column) -> Column:
    flat = F.trim(F.regexp_replace(F.lower(message), r"\s+", " "))
    tokens = F.regexp_extract_all(flat, F.lit("([a-z0-9']+)"), F.lit(1))
    few = (F.size(tokens) <= 3) & F.arrays_overlap(tokens, F.array(*map(F.lit, GENERIC_WORDS)))
    return flat.isin(*GENERIC_PHRASES) | few


def is_generic_text(message: str) -> bool:
    """``is_generic`` for one question on the driver."""
    flat = " ".join(message.lower().split())
    tokens = re.findall(r"[a-z0-9']+", flat)
    return flat in GENERIC_PHRASES or (len(tokens) <= 3 and not set(tokens).isdisjoint(GENERIC_WORDS))


def intent_text(message: str) -> str | None:
    """``intent`` for one question on the driver."""
    low = message.lower()
    return next((kind for kind, words in INTENTS.items() if any(w in low for w in words)), None)


def keyword_top(docs: DataFrame, query: str, k: int = RESULTS, sources: list[str] | None = None) -> DataFrame:
    """Score title and content by the query's words: 5 for a word in the title, 1 for each time in the content.

    ``docs``: doc_id, source, title, content. The sources filter comes first and reaches the scan. Returns the best k with
    score (relative to the best of all) and pos.
    """
    if sources is not None:
        docs = docs.filter(F.col("source").isin(*sources)) if sources else docs.limit(0)
    title, content = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("content", F.lit("")))
    raw = F.lit(0)
    for term in query.lower().split():
        raw = raw + F.contains(title, F.lit(term)).cast("int") * 5 + tx.occurrences(content, term)
    # what scores nothing is dropped after the cut: before it, the scores would be computed twice
    best = docs.withColumn("raw", raw).orderBy(F.desc("raw"), "doc_id").limit(k).filter(F.col("raw") > 0)
    # the best of all is among the best k
    everything, order = Window.partitionBy(), Window.orderBy(F.desc("raw"), "doc_id")
    scored = best.withColumn("score", F.least(F.col("raw") / F.max("raw").over(everything), F.lit(1.0)))
    return scored.withColumn("pos", F.row_number().over(order)).drop("raw")


def vector_top(vectors: DataFrame, query: list[float], k: int, metric: str = "l2", keep: Column | None = None) -> DataFrame:
    """The k vectors of (id, embedding, ...) nearest to one query vector; a filter comes before k.

    The query is a literal, so this is a scan with a per-task top-k; nothing is joined.
    """
    if keep is not None:
        vectors = vectors.filter(keep)
    asked = F.array(*[F.lit(float(x)) for x in query])
    # an array literal is evaluated once a task, not once a row
    score = vec.closeness(vec.squared_l2(F.col("embedding"), asked)) if metric == "l2" else vec.cosine(F.col("embedding"), asked)
    best = vectors.withColumn("score", score).orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def vector_of(vectors: DataFrame, key) -> list[float] | None:
    """One row's vector, by id (a point lookup that the scan prunes)."""
    row = vectors.filter(F.col("id") == key).select("embedding").first()
    return list(row[0]) if row and row[0] is not None else None


def similar_to(vectors: DataFrame, key, k: int, metric: str = "l2") -> DataFrame:
    """The k vectors nearest to a row's own, without it."""
    own = vector_of(vectors, key)
    if own is None:
        return vectors.withColumns({"score": F.lit(0.0), "pos": F.lit(0)}).limit(0)
    return vector_top(vectors, own, k, metric, F.col("id") != key)


def rerank(hits: DataFrame, metadata: DataFrame | None, preferred: str | None = None) -> DataFrame:
    """Raise hits of the preferred document type and lower the others; their own score stays as original_score.

    ``hits``: doc_id, score, pos, ...; ``metadata``: doc_id, doc_type. Hits are few, so they are the side that is
    sent to the metadata; a hit without metadata is an article. Without metadata, hits bring their doc_type.
    """
    typed = hits
    if metadata is not None:
        known = metadata.join(F.broadcast(hits.select("doc_id")), "doc_id", "left_semi").select("doc_id", "doc_type")
        typed = hits.join(known, "doc_id", "left").withColumn("doc_type", F.coalesce("doc_type", F.lit("article")))
    change = F.when(F.col("doc_type") == (preferred or "guide"), BOOST).otherwise(-PENALTY)
    typed = typed.withColumn("original_score", F.col("score")).withColumn("score", F.col("score") + change)
    return typed.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "pos")))


def quality_cut(hits: DataFrame, query: str) -> DataFrame:
    """Drop artifacts and weak hits. A plain call for help keeps only good hits; else weak ones stay if no better are there,

    unless even the first is hopeless. ``hits``: title, url, content, original_score, pos.
    """
    sound = hits.filter(~web.is_binaryish(F.col("title"), F.col("url"), F.col("content")))
    if is_generic_text(query):
        return sound.filter(F.col("original_score") >= GENERIC_FLOOR)
    everything = Window.partitionBy()
    judged = sound.withColumns(
        {
            "_strong": F.col("original_score") >= FLOOR,
            "_any": F.max(F.col("original_score") >= FLOOR).over(everything),
            "_first": F.min_by("original_score", "pos").over(everything),
        }
    )
    stays = F.when(F.col("_any"), F.col("_strong")).otherwise(F.col("_first") >= HOPELESS)
    return judged.filter(stays).drop("_strong", "_any", "_first")


def diversity_cut(hits: DataFrame, per_source: int = PER_SOURCE, results: int = RESULTS) -> DataFrame:
    """At most ``per_source`` hits of a source, best sources first, then filled up by score; few hits pass as they are."""
    everything = Window.partitionBy()
    own = Window.partitionBy("source").orderBy(F.desc("score"), "pos")
    ranked = hits.withColumns(
        {
            "_n": F.count(F.lit(1)).over(everything),
            "_round": F.least(F.row_number().over(own), F.lit(per_source + 1)),
            "_seen": F.min("pos").over(Window.partitionBy("source")),
        }
    )
    few = F.col("_n") <= results
    turn = [F.when(few, F.col("pos")), F.when(few, 0).otherwise(F.col("_round")), F.desc("score"), F.col("_seen"), F.col("pos")]
    placed = ranked.withColumn("_place", F.row_number().over(Window.orderBy(*turn)))
    cut = placed.filter(few | (F.col("_place") <= results))
    return cut.withColumn("pos", F.col("_place").cast("int")).drop("_n", "_round", "_seen", "_place")


def prepare(hits: DataFrame, metadata: DataFrame | None, query: str, preferred: str | None = None) -> DataFrame:
    """What follows every search: re-rank, quality, diversity."""
    return diversity_cut(quality_cut(rerank(hits, metadata, preferred), query))


def api_articles(hits: DataFrame, shown: int = 300) -> DataFrame:
    """Hits as an API gives them: rounded score and a snippet."""
    return hits.select("pos", "doc_id", "title", "source", F.round("score", 3).alias("score"), tx.snippet(F.col("content"), shown).alias("snippet"))


def context_block(hits: DataFrame, preview: int = 500) -> DataFrame:
    """One row: the hits as text for a language model, in order."""
    part = F.format_string(
        "Article #%s: %s\nType: %s\nSource: %s\nRelevance: %.2f\n%s",
        F.col("pos").cast("string"),
        F.col("title"),
        F.initcap("doc_type"),
        F.col("source"),
        F.col("score"),
        tx.snippet_always(F.col("content"), preview),
    )
    parts = F.sort_array(F.collect_list(F.struct("pos", part.alias("part"))))
    return hits.agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n").alias("context"))


def simple_response(hits: DataFrame, shown: int = 5) -> DataFrame:
    """One row: the first titles as a list, what is answered where no language model is."""
    titles = F.sort_array(F.collect_list(F.struct("pos", "title")))
    return hits.agg(F.array_join(F.transform(F.slice(titles, 1, shown), lambda t: F.concat(F.lit("- "), t["title"])), "\n").alias("answer"))


def resolve_sources(
    available: list[str],
    mode: str | None = None,
    exclude: list[str] | None = None,
    include: list[str] | None = None,
    only: list[str] | None = None,
) -> tuple[list[str] | None, list[str]]:
    """The sources that a question is asked of (None: all, []: none) and notes. The list of sources is small and local.

    ``only`` stands alone. Else a base (all sources, or none) loses what is excluded and gains what is included, so that including
    wins. What names nothing, or leaves nothing, asks all sources; an empty ``only`` asks none. A name that is no source is noted
    with the nearest one, unless it is excluded and included alike.
    """
    known, base = set(available), (mode or "all").lower()
    lists = {"only": only or []} if only is not None else {"excluded": exclude or [], "included": include or []}
    if only is None and base not in ("all", "none"):
        return None, [f"{mode!r} is no way to choose sources; all are searched."]
    named = {where: set(names) for where, names in lists.items()}
    twice = named.get("excluded", set()) & named.get("included", set())
    notes = [f"{name!r} is excluded and included; it is searched." for name in sorted(twice)]
    for where, names in lists.items():
        if where == "excluded" and base == "none":
            continue  # nothing to exclude from
        for name in names:
            if name not in known and not (where == "excluded" and name in twice):
                near = get_close_matches(name, sorted(known), n=1, cutoff=0.6)
                notes.append(f"No source is called {name!r} ({where})." + (f" The nearest is {near[0]!r}." if near else ""))
    if only is not None:
        chosen = [name for name in only if name in known]
        if chosen or not only:
            return chosen, notes
    else:
        start = known - named["excluded"] if base == "all" else set()
        chosen = sorted(start | named["included"] & known)
        if base == "all" or chosen:
            return (None if set(chosen) == known and base == "all" else chosen), notes
    return None, notes + ["All sources are searched."] * bool(notes)


def search_with_fallback(docs: DataFrame, query: str, k: int, sources: list[str] | None, vectors: DataFrame | None, embedder=None) -> DataFrame:
    """Vector search where vectors and a model are there and find something, else keyword search; both as doc_id, score, pos."""
    if vectors is not None and embedder is not None:
        asked = [float(x) for x in embedder.embed([query])[0]]
        keep = F.col("source").isin(*sources) if sources else None
        near = vector_top(vectors, asked, k, keep=keep).select(F.col("id").alias("doc_id"), "score", "pos")
        if any(asked) and not near.isEmpty():
            return docs.join(F.broadcast(near), "doc_id")  # k rows
    return keyword_top(docs, query, k, sources)


def similarity_request(message: str) -> int | None:
    """The number of the result that a message wants more like ("more like #2"); 1 if it names none, None if it isn't such a message."""
    low = message.lower()
    if not re.search(r"\b(more like|similar to|like (this|that|#?\d+))\b", low):
        return None
    number = re.search(r"#?\s*(\d+)", low)
    return int(number[1]) if number else 1
