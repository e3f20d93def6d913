"""Schemas of the tables that the operators read and write."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType


def _fields(spec: str, kind) -> list[StructField]:
    return [StructField(n, kind) for n in spec.split()]


_S, _I = StringType(), IntegerType()
PAGES = StructType([*_fields("doc_path doc_name", _S), StructField("page_num", _I), StructField("text", _S), StructField("is_image_page", BooleanType())])
RAW_CHUNKS = StructType([*_fields("text doc_name", _S), StructField("page_num", _I), StructField("chunk_type", _S), StructField("table_index", _I), StructField("ord", LongType())])
INDEX_CHUNK = StructType([*_fields("chunk_id document_id filename document_type chunk_type content article_number section_number section_title subsection_letter subsection_title", _S), *_fields("page_number part", _I)])
WORD_BOXES = StructType([*_fields("doc_name", _S), *_fields("page_num", _I), *_fields("text", _S), *_fields("left top width height conf", _I)])
GRAPH_CHUNK = StructType(
    [*_fields("id text doc_name", _S), StructField("page_num", _I), *_fields("chunk_type doc_type article_ref section_title", _S)]
    + [StructField("embedding", ArrayType(FloatType())), StructField("gnn_embedding", ArrayType(FloatType())), StructField("created_at", TimestampNTZType())]
)
PROGRESS = StructType([*_fields("filename status", _S), StructField("chunks", _I), *_fields("error timestamp_text output", _S)])
