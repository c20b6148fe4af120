"""The document catalog: building, listing, status, deletion and upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import DEFAULTS, DOCUMENT_STATUSES, Settings
from docloom.operators.vectors import index_stats

CATALOG_COLUMNS = [
    "document_id", "filename", "file_type", "file_size", "page_count", "word_count",
    "chunk_count", "has_pii", "pii_categories_found", "created_at", "processed_at", "status",
    "error_message", "has_tree_index", "tree_node_count",
]


def catalog_rows(prepared: DataFrame, *keep: str | Column) -> DataFrame:
    """Catalog rows straight from prepared documents, with the columns in ``keep`` added.

    Chunk count, personal-data flags and node count are taken where they are computed,
    in the document's own row; no join by document id is needed.
    """
    nodes = F.size("nodes") if "nodes" in prepared.columns else F.lit(None).cast("int")
    return prepared.select(
        "document_id",
        "filename",
        "file_type",
        F.col("file_size").cast("long").alias("file_size"),
        F.col("metadata.page_count").alias("page_count"),
        "word_count",
        F.coalesce(F.size("chunks"), F.lit(0)).alias("chunk_count"),
        F.coalesce(F.col("pii.has_pii"), F.lit(False)).alias("has_pii"),
        F.coalesce(F.col("pii.categories_found"), F.array().cast("array<string>")).alias(
            "pii_categories_found"
        ),
        "created_at",
        F.col("processed_at").cast("timestamp").alias("processed_at"),
        "status",
        "error_message",
        F.coalesce(nodes > 0, F.lit(False)).alias("has_tree_index"),
        nodes.alias("tree_node_count"),
        *keep,
    )


def with_flags(catalog: DataFrame, flags: DataFrame) -> DataFrame:
    """Replace the personal-data flags by those of a later detection run."""
    fresh = flags.select(
        "document_id",
        F.col("has_pii").alias("_has"),
        F.col("categories_found").alias("_found"),
    )
    return (
        catalog.join(fresh, "document_id", "left")
        .withColumn("has_pii", F.coalesce("_has", "has_pii"))
        .withColumn("pii_categories_found", F.coalesce("_found", "pii_categories_found"))
        .drop("_has", "_found")
    )


def latest(catalog: DataFrame, by: str = "batch") -> DataFrame:
    """One row per document: that of the last batch. Reduced before the shuffle."""
    others = [c for c in catalog.columns if c not in ("document_id", by)]
    return (
        catalog.groupBy("document_id")
        .agg(F.max_by(F.struct(*others), by).alias("r"))
        .select("document_id", "r.*")
    )


def page_of(catalog: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    """One page, newest first, with ``total`` and ``has_more``.

    A bounded top-n with an offset; each task keeps at most page × page_size rows. The
    total is a scalar subquery, not a join.
    """
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")
    skip = (page - 1) * page_size
    total = catalog.select(F.count(F.lit(1)).alias("n")).scalar()
    rows = (
        catalog.orderBy(F.desc("created_at"), F.asc("document_id"))
        .offset(skip)
        .limit(page_size)
    )
    return (
        rows.withColumn("total", total)
        .withColumn("page", F.lit(page))
        .withColumn("page_size", F.lit(page_size))
        .withColumn("has_more", F.col("total") > skip + page_size)
    )


def page_after(catalog: DataFrame, after: tuple | None = None, page_size: int = 20) -> DataFrame:
    """The page that follows the row ``after`` = (created_at, document_id), newest first.

    A seek: rows up to the cursor are filtered out at the scan, so every page costs the
    same, and rows that arrive in between shift nothing. ``after`` None gives the first page;
    the cursor of the next one is the last row's pair. A null time comes after all others.
    """
    if page_size < 1:
        raise ValueError("page_size starts at 1")
    rows = catalog
    if after is not None:
        at, key = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        later = (F.col("created_at") < at) | F.col("created_at").isNull()
        same, none = F.col("created_at") == at, F.col("created_at").isNull()
        past = none if after[0] is None else same
        rows = rows.where((past & (F.col("document_id") > key)) | (later if after[0] is not None else F.lit(False)))
    return rows.orderBy(F.desc_nulls_last("created_at"), F.asc("document_id")).limit(page_size)


def details(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    return catalog.join(ids.select("document_id"), "document_id", "left_semi")


def latest_status(events: DataFrame) -> DataFrame:
    """Latest state per id from ``id, status, error, progress, ts, seq``, with the times of
    creation, start and completion. One pass, combined inside each task first."""
    def first_at(*wanted: str) -> Column:
        return F.min(F.when(F.col("status").isin(*wanted), F.col("ts")))

    order = F.struct("ts", "seq")
    return (
        events.where(F.col("status").isin(*DOCUMENT_STATUSES))
        .groupBy("id")
        .agg(
            F.max_by(F.struct("status", "error", "progress", "ts"), order).alias("last"),
            F.min("ts").alias("created_at"),
            first_at("processing").alias("started_at"),
        )
        .select(
            "id",
            "last.status",
            F.when(F.col("last.status") == "failed", F.col("last.error")).alias("error"),
            "last.progress",
            "created_at",
            "started_at",
            F.when(F.col("last.status").isin("completed", "failed"), F.col("last.ts")).alias(
                "completed_at"
            ),
        )
    )


def status_counts(states: DataFrame) -> DataFrame:
    """One row with the number of ids in each status."""
    return states.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in DOCUMENT_STATUSES]
    )


def deletion_report(ids: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per requested id: deleted or unknown."""
    known = catalog.select("document_id").distinct().withColumn("_known", F.lit(True))
    deleted = F.coalesce(F.col("_known"), F.lit(False))
    return (
        ids.select("document_id")
        .distinct()
        .join(known, "document_id", "left")
        .select(
            "document_id",
            deleted.alias("deleted"),
            F.when(deleted, "Document deleted").otherwise("Document not found").alias("message"),
        )
    )


def delete_documents(ids: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """What remains of catalog, chunks and vectors, each keyed by ``document_id``."""
    keys = ids.select("document_id").distinct()
    return [t.join(keys, "document_id", "left_anti") for t in tables]


def expired_uploads(files: DataFrame, ttl_seconds: int, now: Column | None = None) -> DataFrame:
    """Uploads older than the time to live, as a list to delete."""
    now = F.current_timestamp() if now is None else now
    ttl = F.make_dt_interval(secs=F.lit(ttl_seconds).cast("decimal(18,6)"))
    return files.where(F.col("modificationTime") < now - ttl)


def stats_snapshot(vectors: DataFrame, at: Column | None = None,
                   dimension: int | None = None) -> DataFrame:
    """Index statistics with their time, to be appended to a history table."""
    at = F.current_timestamp() if at is None else at
    return index_stats(vectors, dimension).withColumn("measured_at", at)
