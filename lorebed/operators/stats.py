"""Per-source statistics, tag and term discovery, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tags import normalise
from ..functions.text import occurrences

#: Topics that titles are searched for (fixed values).
TOPICS = ("water", "solar", "shelter", "food", "garden", "compost", "sanitation", "energy", "filter", "rainwater", "hexayurt")


def source_stats(docs: DataFrame) -> DataFrame:
    """count, chars and the last id by source."""
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("count"), F.sum(F.length("content")).alias("chars"), F.max("doc_id").alias("last_doc"))


def source_totals(docs: DataFrame) -> DataFrame:
    """``source_stats`` with a total row whose source is null."""
    return docs.rollup("source").agg(F.count(F.lit(1)).alias("count"), F.sum(F.length("content")).alias("chars"))


def stats_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """How many sources a rebuild adds, updates, removes and leaves (both: source, count, chars)."""
    joined = old.select("source", F.struct("count", "chars").alias("o")).join(new.select("source", F.struct("count", "chars").alias("n")), "source", "full")
    return joined.agg(
        F.count_if(F.col("o").isNull()).alias("added"),
        F.count_if(F.col("n").isNull()).alias("removed"),
        F.count_if(F.col("o") != F.col("n")).alias("updated"),
        F.count_if(F.col("o") == F.col("n")).alias("unchanged"),
    )


def category_stats(docs: DataFrame) -> DataFrame:
    """count and chars by category; ``docs`` has categories."""
    return docs.select(F.explode("categories").alias("category"), F.length("content").alias("n")).groupBy("category").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("total_chars"))


def counts_over(df: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """Rows by a column's value over a fixed domain; values that don't occur count 0, others aren't counted.

    One sum a value, so that nothing is filtered by the column first (which would work it out twice).
    """
    sums = df.select(column).agg(*[F.count_if(F.col(column) == x).alias(x) for x in domain])
    pairs = F.array(*[F.struct(F.lit(x).alias(column), F.col(f"`{x}`").alias("count")) for x in domain])
    return sums.select(F.inline(pairs))


def topics_by_source(docs: DataFrame, topics: tuple[str, ...] = TOPICS, most: int = 5) -> DataFrame:
    """The first topics, in alphabetical order, that a title of the source has."""
    title = F.lower("title")
    seen = docs.groupBy("source").agg(*[F.bool_or(F.contains(title, F.lit(t))).alias(t) for t in topics])
    named = F.array_compact(F.array(*[F.when(F.col(t), t) for t in sorted(topics)]))
    return seen.select("source", F.slice(named, 1, most).alias("topics"))


def title_terms(docs: DataFrame, stop: list[str], least: int = 2) -> DataFrame:
    """How often normalised words of three letters (a to z) or more stand in titles, without stop words.

    A word is a whole run of letters, digits and underscores of any script.
    """
    words = F.explode(F.regexp_extract_all(F.lower("title"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    terms = docs.select(words.alias("word")).filter(F.col("word").rlike("^[a-z]{3,}$") & ~F.col("word").isin(*stop)).select(normalise(F.col("word")).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def topic_scores(docs: DataFrame, vocabulary: dict[str, list[str]], sample: int = 300) -> DataFrame:
    """How often each topic's keywords occur in titles and snippets: one pass, one row a topic with hits."""
    text = F.lower(F.concat_ws(" ", "title", F.left(F.col("content"), F.lit(sample))))
    sums = []
    for topic, words in vocabulary.items():
        total = F.lit(0)
        for word in words:
            total = total + occurrences(F.col("t"), word)
        sums.append(F.sum(total).alias(topic))
    totals = docs.select(text.alias("t")).agg(*sums)
    pairs = F.array(*[F.struct(F.lit(t).alias("topic"), F.col(t).alias("score")) for t in vocabulary])
    return totals.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("score") > 0)


def combined_tags(topics: DataFrame, terms: DataFrame, most: int = 200) -> DataFrame:
    """Topics and terms in one list; topics come before all terms: their scores are raised by the best term's and one."""
    best = terms.agg(F.coalesce(F.max("n") + 1, F.lit(10_000)).alias("lift"))
    known = topics.join(F.broadcast(best), F.lit(True))  # one row
    known = known.select(F.col("topic").alias("tag"), (F.col("score") + F.col("lift")).alias("score"), F.lit("topic").alias("kind"))
    found = terms.select(F.col("term").alias("tag"), F.col("n").alias("score"), F.lit("term").alias("kind"))
    merged = known.unionByName(found).groupBy("tag").agg(F.max("score").alias("score"), F.max("kind").alias("kind"))
    return merged.orderBy(F.desc("score"), "tag").limit(most)


def tag_histogram(tags: DataFrame, most: int = 6) -> DataFrame:
    """The tags that most sources have; ``tags``: source, tag."""
    return tags.groupBy("tag").agg(F.countDistinct("source").alias("sources")).orderBy(F.desc("sources"), "tag").limit(most)


def tags_against(tags: DataFrame, vocabulary: DataFrame, novel: bool) -> DataFrame:
    """Tags that the vocabulary (tag) lacks, or has, with the sources that use them."""
    side = tags.join(vocabulary.select("tag").distinct(), "tag", "left_anti" if novel else "left_semi")
    return side.groupBy("tag").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.countDistinct("source").alias("n"))


def sample_ids(df: DataFrame, key: str, ident: str, n: int = 3) -> DataFrame:
    """Rows by key and the smallest ids of each; a window that Spark limits before it shuffles keeps hot keys small."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    order = Window.partitionBy(key).orderBy(ident)
    first = df.select(key, ident).withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n)
    lists = first.groupBy(key).agg(F.sort_array(F.collect_list(ident)).alias("samples"))
    return counts.join(lists, key)


def archive_profile(entries: DataFrame, shortest: int = 100) -> DataFrame:
    """One row about entries (mime, text): how many can be indexed, how long they are, how many are skipped."""
    n = F.length(F.coalesce("text", F.lit("")))
    html = F.col("mime") == "text/html"
    return entries.agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(html).alias("html"),
        F.count_if(html & (n >= shortest)).alias("indexable"),
        F.count_if(html & (n < shortest)).alias("skipped"),
        F.round(F.avg(F.when(html & (n >= shortest), n)), 2).alias("mean_length"),
    ).withColumn("skip_rate", F.when(F.col("html") > 0, F.round(F.col("skipped") / F.col("html"), 4)).otherwise(0.0))


def majority_prefix(paths: DataFrame, share: float = 0.8) -> DataFrame:
    """The first segment that at least ``share`` of paths (segment) start with, if there is one."""
    counted = paths.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).filter(F.col("share") >= share).select("segment", F.round("share", 4).alias("share"))


def bad_vectors(vectors: DataFrame) -> DataFrame:
    """null and zero vectors by source."""
    v = F.col("embedding")
    return vectors.groupBy("source").agg(
        F.count_if(v.isNull()).alias("total_null"), F.count_if(F.coalesce(F.forall(v, lambda x: x == 0), F.lit(False))).alias("total_zero")
    )


def vector_quality(vectors: DataFrame, dimension: int, corrupt: Column, zero: Column) -> DataFrame:
    """One row: corrupt, wrongly sized, zero and sound vectors."""
    sized = F.size("embedding") == dimension
    return vectors.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(corrupt).alias("corrupt"),
        F.count_if(~corrupt & ~sized).alias("wrong_dim"),
        F.count_if(~corrupt & sized & zero).alias("zero"),
        F.count_if(~corrupt & sized & ~zero).alias("sound"),
    )


def mean_vector(vectors: DataFrame, key: str) -> DataFrame:
    """The component-wise mean by key: exploded, so partial sums travel instead of vectors."""
    parts = vectors.select(key, F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("mean"))


def nested_mean(parts: DataFrame, key: str, path: str = "path") -> DataFrame:
    """The mean by key of means of halves: a part's ``path`` says which half of which half it is ("", "0", "10"), so it weighs 2**-depth."""
    weight = F.pow(F.lit(0.5), F.length(path))
    rows = parts.select(key, weight.alias("w"), F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy(key, "i").agg(F.sum(F.col("x").cast("double") * F.col("w")).alias("m"))
    return means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("mean"))


def sample(df: DataFrame, key: str, n: int = 10, seed: int = 42) -> DataFrame:
    """``n`` rows at random, the same on every run: those least by a seeded hash of the key. A top-n, not a sort of all."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.orderBy(order, key).limit(n)


def status_summary(rows: DataFrame, status: str = "status") -> DataFrame:
    """One row: passed, failed, total."""
    return rows.agg(
        F.count_if(F.col(status) == "passed").alias("passed"), F.count_if(F.col(status) == "failed").alias("failed"), F.count(F.lit(1)).alias("total")
    )
