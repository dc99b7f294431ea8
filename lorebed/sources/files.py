"""Files as tables: page backups, folder inventories, job logs, manifests. Paths may be in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.web import filename_to_url, html_title, in_asset_folder
from ..schema import JOB, SOURCES


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and modificationTime of all files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")


def backup_size(files: DataFrame) -> DataFrame:
    """Files, bytes and the kind of a backup: an archive before pages before PDFs. All files count, none is sampled."""
    low = F.lower("path")
    return files.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.when(F.bool_or(F.endswith(low, F.lit(".zim"))), "zim")
        .when(F.bool_or(low.rlike(r"\.html?$")), "html")
        .when(F.bool_or(F.endswith(low, F.lit(".pdf"))), "pdf")
        .otherwise("none")
        .alias("kind"),
    )


def pages(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """HTML files as (filename, url, title, html); the URL is the manifest's (url, filename), else made from the name."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.htm*")
    named = files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1).alias("filename"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))
    named = named.filter(~in_asset_folder(F.col("path")))
    if manifest is not None:
        named = named.join(manifest.select("filename", F.col("url").alias("known")), "filename", "left")
    else:
        named = named.withColumn("known", F.lit(None).cast("string"))
    url = F.coalesce("known", filename_to_url(F.col("filename")))
    return named.select("filename", url.alias("url"), html_title(F.col("html"), url).alias("title"), "html")


def pdfs(files: DataFrame) -> DataFrame:
    """PDFs of an inventory, one of each original and its OCR copy, the copy first."""
    found = files.filter(F.lower("path").rlike(r"\.pdf$"))
    base = F.regexp_replace("path", r"(?i)(\.ocr)?\.pdf$", "")
    order = Window.partitionBy("base").orderBy(F.desc(F.lower("path").rlike(r"\.ocr\.pdf$")), "path")
    return found.withColumn("base", base).withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn", "base")


def corrupt_pages(manifest: DataFrame, files: DataFrame, least: int = 100) -> DataFrame:
    """Manifest pages (url, filename) without a file name, without a file (filename, length), or with one below ``least`` bytes."""
    joined = manifest.join(files.select("filename", "length"), "filename", "left")
    return joined.filter(F.col("filename").isNull() | F.col("length").isNull() | (F.col("length") < least)).select("url", "filename", "length")


def manifests(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.schema(SOURCES).option("multiLine", "true").json(pattern)


def job_history(spark: SparkSession, path: str, since: str, limit: int = 100) -> DataFrame:
    """JSON lines of jobs, newest first; lines that are no JSON are dropped."""
    read = spark.read.schema(JOB).option("mode", "DROPMALFORMED").json(path)
    return read.filter(F.col("completed_at") >= since).orderBy(F.desc("completed_at"), "id").limit(limit)
