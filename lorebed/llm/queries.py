"""The queries of this subpackage, each an operator with production parameters over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, licences, mixing, neighbours, packing, quality, simhash, token_store, urls, winnowing
from .common import table
from .tokens import default_vocabulary


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), default_vocabulary())


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edit_likeness(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.document_ids(table(spark, sf_dir, "documents"), default_vocabulary())


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), simhash.Bits(shingle=4, distance=4))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", predicted)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws(':', '42', CAST(doc_id AS VARCHAR), text)) AS ord, row_number() OVER () AS line
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) AS DOUBLE) * 3.0 AS cap,
         row_number() OVER (ORDER BY source IS NULL, source) AS rnk
  FROM d GROUP BY source),
w AS (SELECT *, CAST((rnk - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (
             ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM w),
f AS (SELECT (SELECT lvl FROM l WHERE weight * lvl <= cap ORDER BY cap / weight, rnk LIMIT 1) AS lvl),
t AS (
  SELECT source, source_size, CASE WHEN f.lvl IS NULL THEN cap ELSE least(cap, weight * f.lvl) END AS target FROM l, f),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.*, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS missing,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.line) AS through
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, missing - coalesce(max(CASE WHEN through <= missing THEN through END) OVER (PARTITION BY source), 0) AS rest FROM r),
n AS (
  SELECT source, arg_min(line, (abs(rest - size), ord, line)) AS pick
  FROM e WHERE through > missing AND size > 0 AND abs(rest - size) < rest GROUP BY source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN missing > 0 AND (through <= missing OR line = pick)
       THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM e LEFT JOIN n ON e.source IS NOT DISTINCT FROM n.source
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_best_fit_packing,
        op2_nearest_neighbours,
        op3_document_fingerprints,
        op4_html_extraction,
        op5_token_id_files,
        op6_simhash_near_dedup,
        op7_source_mixing,
        op8_licence_scan,
        op9_quality_classifier,
        op10_url_filter,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op7_source_mixing": OP7_SQL, "op10_url_filter": urls.judge_sql()}
