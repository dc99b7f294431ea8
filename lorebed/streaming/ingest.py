"""Incremental ingest as a stream: files arrive, each micro-batch is merged by key, and a restart repeats nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import keys


def documents_from(pages: DataFrame, source_id: str, text: str = "text", shortest: int = 50, longest: int = 50_000) -> DataFrame:
    """Pages (url, title, text) as documents: key, hash of the text, full length, stored text; short ones are dropped."""
    kept = pages.filter(F.length(text) >= shortest)
    return kept.select(
        keys.html_doc_id(F.lit(source_id), F.col("url")).alias("doc_id"),
        F.lit(source_id).alias("source_id"),
        "url",
        "title",
        keys.content_hash(F.col(text)).alias("content_hash"),
        F.length(text).alias("char_count"),
        F.left(F.col(text), F.lit(longest)).alias("content"),
    )


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at ``path``; empty while there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def part_of(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("key_part")


def append_new(path: str, key: str = "doc_id", parts: int = 1024) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends rows whose key isn't stored. A batch that is run again finds its rows there.

    The table is partitioned by a hash of the key, so that a batch reads the keys of the folders that its own keys fall in
    and not the whole table.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key]).withColumn("key_part", part_of(key, parts)).persist()
        try:
            touched = [r.key_part for r in new.select("key_part").distinct().collect()]  # at most ``parts`` numbers
            if not touched:
                return
            have = stored(spark, path, new.schema).filter(F.col("key_part").isin(touched)).select(key)
            new.join(have, key, "left_anti").write.mode("append").partitionBy("key_part").parquet(path)
        finally:
            new.unpersist()

    return write


def ingest(spark: SparkSession, folder: str, schema: StructType, source_id: str, out: str, checkpoint: str, per_batch: int = 100) -> StreamingQuery:
    """Start (or resume) the ingest of page files at ``folder`` into the table ``out``; returns when what is there is read."""
    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)
    docs = documents_from(pages, source_id)
    query = docs.writeStream.foreachBatch(append_new(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def failures(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Failures by user and window of a stream (or table) of events: user_id, ts, event_type; late rows are dropped."""
    failed = events.filter(F.col("event_type") == "error")
    if events.isStreaming:
        failed = failed.withWatermark("ts", late)
    counted = failed.groupBy(F.window("ts", width), "user_id").agg(F.count(F.lit(1)).alias("failures"))
    return counted.select(F.col("window.start").alias("since"), "user_id", "failures")
