"""Stable keys. The fallback for a document without id or hash is a hash of its URL, the same in every process."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def html_doc_id(source_id: Column, url: Column) -> Column:
    return F.md5(F.concat_ws(":", source_id, url).cast("binary"))


def content_hash(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def short_hash(text: Column) -> Column:
    return F.left(content_hash(text), F.lit(12))


def pdf_doc_id(source_id: Column, text: Column) -> Column:
    return F.concat_ws("_", source_id, short_hash(text))


def chunk_id(doc_id: Column, index: Column, total: Column) -> Column:
    return F.when(total > 1, F.concat(doc_id, F.lit("_chunk"), index.cast("string"))).otherwise(doc_id)


def fallback_id(doc_id: Column, content_hash: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(doc_id, F.lit("")), F.nullif(content_hash, F.lit("")), F.md5(F.coalesce(url, F.lit("")).cast("binary")))
