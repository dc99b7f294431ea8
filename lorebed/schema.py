"""Types of the tables: explicit, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _B, _I, _L, _D = T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CATEGORY_STATS = T.MapType(_S, _struct(count=_I, total_chars=_L))
SOURCES = _struct(
    schema_version=_I, source_id=_S, name=_S, description=_S, license=_S, license_verified=_B, license_notes=_S, attribution=_S,
    base_url=_S, links_verified_offline=_B, links_verified_online=_B, language=_S, language_verified=_B, tags=T.ArrayType(_S),
    total_docs=_I, total_chars=_L, categories=CATEGORY_STATS, version=_S, has_backup=_B, has_metadata=_B, has_index=_B, has_vectors=_B,
    backup_size_bytes=_L, metadata_size_bytes=_L, index_size_bytes=_L, vectors_size_bytes=_L, total_size_bytes=_L, created_at=_S,
    last_backup=_S, last_indexed=_S,
)
DOC_METADATA = _struct(
    doc_id=_S, source_id=_S, title=_S, url=_S, local_url=_S, content_hash=_S, char_count=_I, categories=T.ArrayType(_S), doc_type=_S,
    scraped_at=_S, internal_links=T.ArrayType(_S), parent_pdf=_S, page_start=_I, page_end=_I, chunk_index=_I, total_chunks=_I,
    total_pages=_I,
)
DOC_CONTENT = _struct(doc_id=_S, source_id=_S, title=_S, url=_S, local_url=_S, content=_S, categories=T.ArrayType(_S), doc_type=_S)
VECTORS = _struct(doc_id=_S, source_id=_S, embedding=T.ArrayType(T.FloatType()), dimension=_I, embedding_model=_S)
BACKUP_PAGES = _struct(url=_S, filename=_S, title=_S, size=_L)
SCRAPED_PAGE = _struct(
    url=_S, title=_S, content=_S, source=_S, categories=T.ArrayType(_S), last_modified=_S, content_hash=_S, scraped_at=_S,
    internal_links=T.ArrayType(_S),
)
SEGMENT = _struct(
    segment_id=_S, start_sec=_D, end_sec=_D, text=_S, language=_S, source_kind=_S, original_segment_ids=T.ArrayType(_S)
)
CHUNK = _struct(
    chunk_id=_S, video_id=_S, start_sec=_D, end_sec=_D, text=_S, language=_S, original_segment_ids=T.ArrayType(_S)
)
JOB = _struct(
    id=_S, job_type=_S, source_id=_S, status=_S, progress=_I, message=_S, result=_S, error=_S, created_at=_S, started_at=_S,
    completed_at=_S, duration_seconds=_D,
)
