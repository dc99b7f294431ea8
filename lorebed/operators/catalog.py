"""Packs, catalogs and lists of sources: joins of manifests, counts and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import display_name
from .classify import tier


def packs(manifests: DataFrame, counts: DataFrame) -> DataFrame:
    """Manifests of indexed sources with counts and tier; manifests: source_id, name, license, license_verified; counts: source, count, chars."""
    own = manifests.join(counts.withColumnRenamed("source", "source_id"), "source_id")
    return own.select("source_id", "name", "license", tier(F.col("license"), F.col("license_verified")).alias("tier"), F.col("count").alias("doc_count"), "chars").withColumn(
        "downloadable", F.col("tier") != "personal"
    )


def health(manifests: DataFrame, counts: DataFrame) -> DataFrame:
    """Sources by where they are: configured, indexed or both."""
    from .sync import set_difference

    sides = set_difference(manifests.select(F.col("source_id").alias("source")), counts, "source")
    name = F.when(F.col("side") == "left", "unindexed").when(F.col("side") == "right", "unconfigured").otherwise("ok")
    return sides.groupBy(name.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def entries(active: DataFrame, published: DataFrame, manifests: DataFrame, counts: DataFrame) -> DataFrame:
    """Catalog entries, and for sources left out the reason; active, published: source_id."""
    known = active.join(published.withColumn("pub", F.lit(True)), "source_id", "left").join(manifests.withColumn("man", F.lit(True)), "source_id", "left")
    full = known.join(counts.select(F.col("source").alias("source_id"), "count"), "source_id", "left")
    reason = F.when(F.col("pub").isNull(), "not published").when(F.col("man").isNull(), "no manifest").otherwise("included")
    return full.select(
        "source_id",
        display_name(F.col("name"), source_id=F.col("source_id")).alias("name"),
        F.coalesce("license", F.lit("Unknown")).alias("license"),
        F.coalesce("count", F.lit(0)).alias("doc_count"),
        reason.alias("status"),
    )


def active_packs(installed: DataFrame, selected: DataFrame) -> DataFrame:
    """Installed sources that are selected; all of them if none is selected."""
    chosen = selected.select("source_id").distinct().withColumn("sel", F.lit(True))
    any_chosen = F.broadcast(chosen.agg((F.count(F.lit(1)) > 0).alias("some")))  # one row
    joined = installed.select("source_id").join(chosen, "source_id", "left").join(any_chosen, F.lit(True))
    return joined.filter(F.col("sel").isNotNull() | ~F.col("some")).select("source_id")


def install(vectors: DataFrame, documents: DataFrame) -> DataFrame:
    """Vectors with their documents; vectors without one are dropped."""
    return vectors.join(documents, "doc_id")


def reindex(vectors: DataFrame, documents: DataFrame) -> DataFrame:
    """Vectors with their content; vectors without a document keep an empty one."""
    return vectors.join(documents.select("doc_id", "content"), "doc_id", "left").withColumn("content", F.coalesce("content", F.lit("")))


def first_match(asked: DataFrame, index: DataFrame) -> DataFrame:
    """For each request (id, candidates: an ordered array of URLs) the first that the index (url, entry) has."""
    tried = asked.select("id", F.posexplode("candidates").alias("pos", "url"))
    return tried.join(index, "url").groupBy("id").agg(F.min_by("entry", "pos").alias("entry"), F.min("pos").alias("pos"))


def local_sources(folders: DataFrame, master: DataFrame) -> DataFrame:
    """Sources with a folder (source_id) or in the master table (source, count): orphaned without the one, to be validated without the other."""
    own = folders.select("source_id").withColumn("f", F.lit(True))
    known = master.select(F.col("source").alias("source_id"), "count")
    joined = own.join(known, "source_id", "full")
    return joined.select(
        "source_id", F.coalesce("count", F.lit(0)).alias("doc_count"), F.col("f").isNull().alias("is_orphaned"), F.col("count").isNull().alias("needs_validation")
    )


def uploadable(sources: DataFrame) -> DataFrame:
    """Sources, complete ones first."""
    complete = F.col("has_backup") & F.col("has_metadata") & F.col("has_manifest")
    return sources.select("source_id", complete.alias("is_complete")).orderBy(F.desc("is_complete"), "source_id")


def repair_urls(docs: DataFrame, prefix: str, base: str) -> DataFrame:
    """Documents whose url is an archive's get it as local_url, and the site's in its place."""
    archived = F.startswith("url", F.lit(prefix))
    site = F.concat(F.lit(base), F.substr("url", F.lit(len(prefix) + 1)))
    # both from the old value
    return docs.withColumns({"url": F.when(archived, site).otherwise(F.col("url")), "local_url": F.when(archived, F.col("url")).otherwise(F.col("local_url"))})
