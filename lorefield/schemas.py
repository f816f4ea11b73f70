"""Row shapes of the knowledge base tables."""

from __future__ import annotations

from pyspark.sql import types as T

MANIFEST = T.StructType(
    [
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("file_name", T.StringType(), False),
        T.StructField("source_type", T.StringType(), False),
        T.StructField("content_hash", T.StringType(), False),
        T.StructField("chunk_count", T.IntegerType(), False),
        T.StructField("size_bytes", T.LongType(), False),
        T.StructField("date_added", T.TimestampType(), False),
    ]
)

DOC_STATUS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("track_id", T.StringType()),
        T.StructField("status", T.StringType(), False),
        T.StructField("file_path", T.StringType()),
        T.StructField("chunks_count", T.IntegerType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("content_length", T.LongType()),
        T.StructField("error_msg", T.StringType()),
    ]
)

DOCUMENT_SOURCE = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

CHUNK = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("source_doc", DOCUMENT_SOURCE),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("token_count", T.IntegerType()),
        T.StructField("char_count", T.IntegerType()),
        T.StructField("content_hash", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("created_at", T.TimestampType()),
    ]
)

MENTION = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)

ENTITY = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("entity_type", T.StringType(), False),
        T.StructField("description", T.StringType()),
        T.StructField("source_chunks", T.ArrayType(T.StringType())),
        T.StructField("source_docs", T.ArrayType(T.StringType())),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
        T.StructField("first_seen", T.TimestampType()),
        T.StructField("last_seen", T.TimestampType()),
    ]
)

RELATIONSHIP = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("target", T.StringType(), False),
        T.StructField("relation_type", T.StringType(), False),
        T.StructField("description", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("source_chunks", T.ArrayType(T.StringType())),
        T.StructField("source_docs", T.ArrayType(T.StringType())),
        T.StructField("bidirectional", T.BooleanType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

CHAT_MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])

CRAWLED = T.StructType(
    [
        T.StructField("url", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("crawled_at", T.TimestampType()),
        T.StructField("content_hash", T.StringType()),
    ]
)

STREAM_EVENT = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("payload", T.StringType()),
    ]
)
