"""The provided tables in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_line


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as (doc_id, source, lang, title, content)."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", first_line(F.col("text")).alias("title"), F.col("text").alias("content"))


def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as (id, embedding, source); a label is a source."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("src"), F.col("label").cast("string")).alias("source"))


def spread(scan: DataFrame) -> DataFrame:
    """A scan of few splits dealt over all cores, for work that costs far more than moving the rows; one of many splits stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < 2 * cores else scan
