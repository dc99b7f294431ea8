"""Snapshots compared and merged: diffs, incremental plans, upserts, deletes, renames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import is_null_or_zero


def diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """doc_id and what a sync does with it; both sides: doc_id, content_hash, scraped_at (ISO text).

    Equal hashes are in sync. If they differ, a local side that is as new or newer is an update, else a conflict.
    """
    l = local.select("doc_id", F.col("content_hash").alias("lh"), F.col("scraped_at").alias("lt"))  # noqa: E741
    r = remote.select("doc_id", F.col("content_hash").alias("rh"), F.col("scraped_at").alias("rt"))
    both = l.withColumn("l", F.lit(True)).join(r.withColumn("r", F.lit(True)), "doc_id", "full")
    newer = F.coalesce("lt", F.lit("")) >= F.coalesce("rt", F.lit(""))
    action = (
        F.when(F.col("r").isNull(), "push")
        .when(F.col("l").isNull(), "pull")
        .when(F.col("lh").eqNullSafe(F.col("rh")), "in_sync")
        .when(newer, "update")
        .otherwise("conflict")
    )
    return both.select("doc_id", action.alias("action"))


def diff_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def push_plan(changes: DataFrame, force: bool = False) -> DataFrame:
    """What a push sends; nothing while there are conflicts, unless forced."""
    conflicts = changes.agg(F.count_if(F.col("action") == "conflict").alias("conflicts"))
    sent = changes.filter(F.col("action").isin("push", "update", *(["conflict"] if force else [])))
    if force:
        return sent
    return sent.join(F.broadcast(conflicts), F.lit(True)).filter("conflicts = 0").select("doc_id", "action")  # one row


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Each key and where it is: left, right or both."""
    l = left.select(key).distinct().withColumn("l", F.lit(True))  # noqa: E741
    r = right.select(key).distinct().withColumn("r", F.lit(True))
    where = F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").otherwise("both")
    return l.join(r, key, "full").select(key, where.alias("side"))


def incremental_plan(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """id and action for incoming ids: insert what is new, replace what is stored without a sound vector, skip the rest."""
    have = stored.select("id", is_null_or_zero(F.col("embedding")).alias("bad"))
    action = F.when(F.col("bad").isNull(), "insert").when(F.col("bad"), "replace").otherwise("skip")
    return incoming.select("id").join(have, "id", "left").select("id", action.alias("action"))


def upsert(stored: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of both, the last version of each key; incoming ones win ties."""
    both = stored.withColumn("_from", F.lit(0)).unionByName(incoming.withColumn("_from", F.lit(1)))
    order = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_from"))
    return both.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn", "_from")


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti")


def rename(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) == old, new).otherwise(F.col(column)))


def merge_manifest(existing: DataFrame, archive: DataFrame, fields: list[str], defaults: dict[str, str]) -> DataFrame:
    """One row a source: what a person entered stays, else what the archive says, else a default."""
    e = existing.select("source_id", *[F.col(f).alias(f"e_{f}") for f in fields])
    a = archive.select("source_id", *[F.col(f).alias(f"a_{f}") for f in fields])
    value = lambda f: F.coalesce(F.nullif(f"e_{f}", F.lit("")), F.nullif(f"a_{f}", F.lit("")), F.lit(defaults.get(f, "")))
    return e.join(a, "source_id", "full").select("source_id", *[value(f).alias(f) for f in fields])


def crossref(metadata: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: ids on both sides, and those without their other half; both sides: doc_id."""
    sides = set_difference(metadata, vectors, "doc_id")
    counted = sides.agg(
        F.count_if(F.col("side") != "right").alias("metadata"),
        F.count_if(F.col("side") != "left").alias("vectors"),
        F.count_if(F.col("side") == "left").alias("without_vector"),
        F.count_if(F.col("side") == "right").alias("without_metadata"),
    )
    return counted


def coverage(counts: DataFrame) -> DataFrame:
    """Ratios of ``crossref`` and what they mean: below 50 % is invalid, below 90 % a warning, as are 10 % missing or 5 % orphaned."""
    found = F.when(F.col("metadata") > 0, (F.col("metadata") - F.col("without_vector")) / F.col("metadata")).otherwise(0.0)
    orphans = F.when(F.col("vectors") > 0, F.col("without_metadata") / F.col("vectors")).otherwise(0.0)
    rated = counts.withColumns({"coverage": F.round(found, 4), "orphaned": F.round(orphans, 4)})
    state = F.when(F.col("coverage") < 0.5, "invalid").when((F.col("coverage") < 0.9) | (F.col("orphaned") > 0.05), "warning").otherwise("ok")
    return rated.withColumn("state", state)
