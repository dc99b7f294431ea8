"""Binary files as rows, by a parser that is a parameter: PDFs to pages, archives to entries, captions to segments."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Where captions are packaged, best first (fixed values).
CAPTION_ENDS = (".json", ".srt", ".vtt", ".txt")

Parse = Callable[[str, bytes], Iterable[tuple]]


def read(spark: SparkSession, folder: str, glob: str, parse: Parse, schema: str) -> DataFrame:
    """What ``parse(path, content)`` yields for each file, on the executors; ``schema`` describes its tuples."""
    import pandas as pd

    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = list(parse(path, content))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return found.select("path", "content").mapInPandas(run, schema)


def pdf_text_stats(pages: DataFrame, least: int = 500) -> DataFrame:
    """Characters, pages and pages with text of each PDF (pdf, text), and whether that is enough to use."""
    n = F.length(F.trim(F.coalesce("text", F.lit(""))))
    stats = pages.groupBy("pdf").agg(F.sum(n).alias("total_chars"), F.count_if(n > 0).alias("text_pages"), F.count(F.lit(1)).alias("pages"))
    return stats.withColumn("usable", F.col("total_chars") >= least)


def best_captions(files: DataFrame) -> DataFrame:
    """One file a video (video_id, path): the best of its endings, then the first path."""
    rank = None
    for k, end in enumerate(CAPTION_ENDS):
        fits = F.endswith(F.lower("path"), F.lit(end))
        rank = F.when(fits, k) if rank is None else rank.when(fits, k)
    ranked = files.withColumn("rank", rank).filter(F.col("rank").isNotNull())
    return ranked.groupBy("video_id").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def json_captions(files: DataFrame) -> DataFrame:
    """Segments of JSON captions (video_id, text): a list, or an object with ``segments``; seconds by any of the usual names."""
    item = "array<struct<start:double,start_sec:double,end:double,end_sec:double,duration:double,text:string>>"
    listed = F.coalesce(F.from_json(F.get_json_object("text", "$.segments"), item), F.from_json("text", item))
    rows = files.select("video_id", F.posexplode(listed).alias("pos", "s"))
    start = F.coalesce("s.start_sec", "s.start", F.lit(0.0))
    end = F.coalesce("s.end_sec", "s.end", start + F.coalesce("s.duration", F.lit(0.0)))
    return rows.select("video_id", "pos", start.alias("start_sec"), end.alias("end_sec"), F.trim("s.text").alias("text")).filter("text <> ''")


def plain_captions(files: DataFrame) -> DataFrame:
    """A plain text as one segment without time."""
    return files.select("video_id", F.lit(0).alias("pos"), F.lit(0.0).alias("start_sec"), F.lit(0.0).alias("end_sec"), F.trim("text").alias("text")).filter("text <> ''")


def published(master: DataFrame, listing: DataFrame) -> DataFrame:
    """Published sources: the master's (source_id), or, if it has none, the first folders of a listing (key)."""
    folders = listing.select(F.split_part("key", F.lit("/"), F.lit(1)).alias("source_id")).filter("source_id <> ''").distinct()
    some = F.broadcast(master.agg((F.count(F.lit(1)) > 0).alias("some")))  # one row
    fallback = folders.join(some, F.lit(True)).filter(~F.col("some")).select("source_id")
    return master.select("source_id").unionByName(fallback)


def systematic(entries: DataFrame, order: str, n: int = 10) -> DataFrame:
    """About ``n`` entries at even steps, from a tenth of the way in. Positions come from ranges of ``order``, not from one task."""
    total = entries.count()
    if total <= n:
        return entries
    first, step = total // 10, max(1, total // (2 * n))
    ordered = entries.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    ordered = ordered.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row a task
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.col("_rn") + F.col("_before") - 1
    chosen = (at >= first) & ((at - first) % step == 0) & ((at - first) / step < n)
    return ordered.join(F.broadcast(before.select("_part", "_before")), "_part").filter(chosen).drop("_part", "_rn", "_before")


def sitemap_profile(maps: DataFrame, opened: int = 5) -> DataFrame:
    """One row about sub-sitemaps (pos, text): URLs counted in the first ``opened``, and what all would hold at their mean."""
    urls = F.size(F.regexp_extract_all("text", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)))
    counted = maps.agg(F.count(F.lit(1)).alias("sitemaps"), F.sum(F.when(F.col("pos") < opened, urls)).alias("counted"))
    mean = F.col("counted") / F.least("sitemaps", F.lit(opened))
    return counted.withColumn("estimated", F.when(F.col("sitemaps") > opened, F.round(mean * F.col("sitemaps"))).otherwise(F.col("counted")).cast("long"))


def keep_first(df: DataFrame, keys: list[str], pos: Column | str) -> DataFrame:
    """The first row of each key by ``pos``."""
    order = Window.partitionBy(*keys).orderBy(pos)
    return df.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def first_matching(entries: DataFrame, text: str, order: str = "entry_id", scanned: int = 10_000, most: int = 50) -> DataFrame:
    """Of the first ``scanned`` entries (title, url) those whose title or URL holds ``text``, at most ``most``: a look into an archive."""
    seen = entries.orderBy(order).limit(scanned)
    low = F.lit(text.lower())
    return seen.filter(F.contains(F.lower("title"), low) | F.contains(F.lower("url"), low)).orderBy(order).limit(most)
