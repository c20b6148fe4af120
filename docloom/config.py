"""Settings shared by the jobs. Plain values; nothing is read from the environment."""

from __future__ import annotations

from dataclasses import dataclass

# The formats, limits and defaults every job starts from.
ALLOWED_FILE_TYPES = ("pdf", "docx", "pptx", "xlsx", "txt", "md", "html", "png", "jpg", "jpeg")
PII_CATEGORIES = ("password", "api_key", "credit_card", "ssn", "email", "phone", "address")
REDACTION_REQUEST_CATEGORIES = ("password", "api_key", "credit_card")
DOCUMENT_STATUSES = ("pending", "processing", "completed", "failed")


@dataclass(frozen=True)
class Settings:
    namespace: str = "default"
    allowed_file_types: tuple[str, ...] = ALLOWED_FILE_TYPES
    max_upload_bytes: int = 50 * 1024 * 1024

    embedding_dimension: int = 384
    encode_batch: int = 32
    cache_enabled: bool = True
    cache_ttl_seconds: int = 3600
    cache_max_entries: int = 10_000
    cache_evict_entries: int = 5_000
    # Hex digits of the text key that name a partition of the stored cache: 16 or 256 parts.
    cache_prefix_digits: int = 1

    chunk_size: int = 1000
    chunk_overlap: int = 200

    top_k: int = 5
    max_top_k: int = 50
    similarity_threshold: float = 0.7
    snippet_chars: int = 200
    max_query_chars: int = 1000
    max_agent_query_chars: int = 2000

    node_max_pages: int = 10
    node_max_tokens: int = 20_000

    pii_enabled: bool = True

    # Physical limits. Up to this many bytes of queries are sent to every task.
    broadcast_query_bytes: int = 32 * 1024 * 1024
    # Hits of about 100 bytes each that may be sent to every task of a following join.
    broadcast_hits: int = 100_000
    # Ids that a fetch of winners pushes into the scan one by one.
    pushed_ids: int = 1_000
    # Keys of the changes since the last compaction are sent to every task up to this many
    # bytes; more of them take the shuffle.
    broadcast_key_bytes: int = 64 * 1024 * 1024
    # Keys treated as hot when a table with repeated keys is joined. The list is
    # bounded by this number, so it can be broadcast whatever the data size.
    max_hot_keys: int = 1000
    rows_per_salt: int = 50_000
    max_salts: int = 1024
    top_n_salts: int = 16


DEFAULTS = Settings()
