"""Explicit schemas as DDL; nothing is inferred."""

from __future__ import annotations

METADATA = (
    "filename STRING, file_type STRING, page_count INT, has_tables BOOLEAN, has_images BOOLEAN, "
    "title STRING, author STRING, table_count INT, image_count INT"
)
EMBEDDING_CACHE = (
    "text_key STRING, embedding ARRAY<FLOAT>, inserted_seq BIGINT, inserted_at TIMESTAMP"
)
VECTORS = (
    "namespace STRING, id STRING, document_id STRING, values ARRAY<FLOAT>, metadata VARIANT"
)
# The catalog as ingest stores it, one row per document and batch.
STORED_CATALOG = (
    "document_id STRING, filename STRING, file_type STRING, file_size BIGINT, page_count INT, "
    "word_count INT, chunk_count INT, has_pii BOOLEAN, pii_categories_found ARRAY<STRING>, "
    "created_at TIMESTAMP, processed_at TIMESTAMP, status STRING, error_message STRING, "
    "has_tree_index BOOLEAN, tree_node_count INT, namespace STRING, table_count INT, "
    "image_count INT"
)
