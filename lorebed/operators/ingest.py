"""Writing packs: documents, vectors, manifests; partitioned so that a source or a dimension is a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import is_corrupt, is_null_or_zero


def store_form(docs: DataFrame) -> DataFrame:
    """Documents as a vector store takes them: flat, categories as JSON, no links."""
    return docs.withColumn("categories", F.to_json(F.coalesce("categories", F.array().cast("array<string>")))).drop("internal_links")


def hosted_form(docs: DataFrame) -> DataFrame:
    """Shortened for a hosted store: title and categories 500, a preview of 1000, no zero vectors."""
    kept = docs.filter(~is_null_or_zero(F.col("embedding")))
    left = lambda c, n: F.left(F.coalesce(c, F.lit("")), F.lit(n)).alias(c)
    return kept.select("id", "embedding", left("title", 500), left("categories", 500), F.left(F.coalesce("content", F.lit("")), F.lit(1000)).alias("preview"))


def categories_of(json: str):
    """A JSON text of categories as an array; empty if it is none."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def write_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Sound vectors by dimension."""
    kept = vectors.filter(~is_corrupt(F.col("embedding"))).withColumn("dimension", F.size("embedding"))
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dimension").parquet(path)


def index_skips(pages: DataFrame, shortest: int = 100) -> DataFrame:
    """Pages kept and dropped, by reason (path, text)."""
    from ..functions.web import in_asset_folder

    reason = F.when(in_asset_folder(F.col("path")), "asset").when(F.length(F.coalesce("text", F.lit(""))) < shortest, "short").otherwise("kept")
    return pages.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
