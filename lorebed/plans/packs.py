"""Packs: a source's documents, vectors and manifest as one folder; made, read and installed into a store of documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.maintenance import install_into
from ..sources.store import Store

MANIFEST = "_manifest.json"


def create(spark: SparkSession, folder: str, source_id: str, documents: DataFrame, vectors: DataFrame, **fields: str) -> dict:
    """Write a pack; its manifest is written last, so a pack that has one is whole."""
    documents.write.mode("overwrite").parquet(f"{folder}/documents")
    with_document = vectors.join(documents.select("doc_id"), "doc_id", "left_semi")
    with_document.write.mode("overwrite").parquet(f"{folder}/vectors")
    counts = {name: spark.read.parquet(f"{folder}/{name}").count() for name in ("documents", "vectors")}
    manifest = {**fields, "source_id": source_id, **counts}
    Store(spark, folder).write(MANIFEST, json.dumps(manifest).encode())
    return manifest


def manifest_of(spark: SparkSession, folder: str) -> dict | None:
    store = Store(spark, folder)
    return json.loads(store.read(MANIFEST)) if store.exists(MANIFEST) else None


def install(spark: SparkSession, folder: str, into: str, mode: str = "update") -> int:
    """Install a whole pack into the store of documents at ``into``; returns its documents.

    The new store is written beside the old one and then takes its place, so that a stopped install leaves the old one.
    """
    manifest = manifest_of(spark, folder)
    if manifest is None:
        raise ValueError(f"{folder} holds no whole pack")
    pack = spark.read.parquet(f"{folder}/documents").withColumn("source", F.lit(manifest["source_id"]))
    parent, name = into.rstrip("/").rsplit("/", 1)
    store = Store(spark, parent)
    if store.exists(name):
        old = spark.read.parquet(into)
        pack = install_into(old, pack.select(old.columns), mode, source="source")
    pack.write.mode("overwrite").parquet(f"{into}.new")
    store.delete(name)
    store.move(f"{name}.new", name)
    return manifest["documents"]


def install_all(spark: SparkSession, packs: str, names: list[str], into: str, mode: str = "update") -> dict[str, int]:
    """Install packs by name from a folder of packs, one after the other."""
    return {name: install(spark, f"{packs.rstrip('/')}/{name}", into, mode) for name in names}
