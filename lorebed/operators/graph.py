"""The link graph and the map of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import short_title


def _path(url: Column) -> Column:
    """A URL without scheme, host, fragment, query and leading slash."""
    return F.regexp_extract(url, r"^(?:[a-z]+://[^/?#]*)?/?([^?#]*)", 1)


def link_edges(pages: DataFrame) -> DataFrame:
    """Undirected edges between pages (id, host, url, local_url, links); a link fits a page's URL, else its local URL.

    Each form of an address is a key of an equi-join within a host; of the pages that fit, the one by URL wins, then
    the smallest id. No self loops; of both directions the one from the smaller source id is kept.
    """
    links = pages.select("id", "host", F.posexplode("links").alias("pos", "link")).select("id", "host", "pos", _path(F.col("link")).alias("path"))
    by_url = pages.select("host", _path(F.col("url")).alias("path"), F.col("id").alias("to"), F.lit(0).alias("rank"))
    by_local = pages.filter(F.col("local_url").isNotNull()).select("host", _path(F.col("local_url")).alias("path"), F.col("id").alias("to"), F.lit(1).alias("rank"))
    # an address names one page
    keys = by_url.unionByName(by_local).filter("path <> ''").groupBy("host", "path").agg(F.min(F.struct("rank", "to")).alias("m"))
    found = links.filter("path <> ''").join(keys, ["host", "path"]).select("id", "pos", F.col("m.to").alias("to")).filter(F.col("id") != F.col("to"))
    pair = [F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")]
    first = found.groupBy(*pair).agg(F.min(F.struct("id", "pos", "to")).alias("f"))
    return first.select(F.col("f.id").alias("src"), F.col("f.to").alias("dst"))


def points(vectors: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` principal coordinates of each vector (id, embedding), centred, rounded to 3 decimals.

    The covariance is one aggregation; signs are fixed so that each component's largest loading is positive.
    """
    import numpy as np
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    dense = vectors.select("id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(dense)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), range(k)])
    mean = dense.select(Summarizer.mean(F.col("v")).alias("m")).first()["m"].toArray()
    shift = mean @ loadings
    raw = vector_to_array("p")
    axes = [F.round((raw[i] - float(shift[i])) * float(signs[i]), 3).alias(n) for i, n in enumerate("xyzuvw"[:k])]
    return model.transform(dense).select("id", *axes)


def labelled(points_: DataFrame, titles: DataFrame) -> DataFrame:
    """Points with titles cut to 80 characters."""
    return points_.join(titles, "id").withColumn("title", short_title(F.col("title")))


def write_map(points_: DataFrame, edges: DataFrame, path: str) -> None:
    """The map as three tables by source: points (id, source, title, x, y, z), their URLs, and edges (src, dst, source)."""
    points_.drop("url").write.mode("overwrite").partitionBy("source").parquet(f"{path}/points")
    points_.select("id", "url", "source").write.mode("overwrite").partitionBy("source").parquet(f"{path}/urls")
    edges.write.mode("overwrite").partitionBy("source").parquet(f"{path}/edges")


def read_map(spark: SparkSession, path: str, table: str, sources: list[str] | None = None) -> DataFrame:
    """One of the map's tables, of some sources; only their folders are read."""
    whole = spark.read.parquet(f"{path}/{table}")
    return whole.filter(F.col("source").isin(*sources)) if sources else whole
