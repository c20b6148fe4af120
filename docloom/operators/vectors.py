"""Vector records: building, contract, upsert, fetch, delete and statistics.

A record is ``namespace, id, document_id, values, metadata``. ``document_id`` is
promoted out of the open metadata so that filters on it reach the scan.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import DEFAULTS, Settings
from docloom.operators.filters import metadata_filter

KEY = ["namespace", "id"]
PROMOTED = ("namespace", "id", "document_id")


def record_filter(condition: Mapping[str, Any] | None, df: DataFrame) -> Column:
    promoted = {"document_id": F.col("document_id")} if "document_id" in df.columns else {}
    metadata = F.col("metadata") if "metadata" in df.columns else None
    return metadata_filter(condition, metadata, promoted)


def vector_records(chunks: DataFrame, namespace: Column | str | None = None,
                   settings: Settings = DEFAULTS) -> DataFrame:
    """Embedded chunks as records: chunk metadata plus the document id and the text,
    which search results are read from."""
    ns = F.lit(namespace) if namespace is None or isinstance(namespace, str) else namespace
    metadata = F.struct("metadata.*", "document_id", "content")
    return chunks.select(
        F.coalesce(ns, F.lit(settings.namespace)).alias("namespace"),
        F.col("chunk_id").alias("id"),
        "document_id",
        F.col("embedding").alias("values"),
        F.to_variant_object(metadata).alias("metadata"),
    )


def normalize_records(df: DataFrame, namespace: str | None = None,
                      settings: Settings = DEFAULTS) -> DataFrame:
    """Fill what a caller may leave out: namespace, metadata (empty object), document id."""
    ns = F.col("namespace") if "namespace" in df.columns else F.lit(namespace)
    metadata = F.col("metadata") if "metadata" in df.columns else F.lit(None).cast("variant")
    from_metadata = F.try_variant_get(metadata, "$.document_id", "string")
    doc = F.col("document_id") if "document_id" in df.columns else from_metadata
    return df.select(
        F.coalesce(F.nullif(ns, F.lit("")), F.lit(namespace or settings.namespace)).alias("namespace"),
        "id",
        doc.alias("document_id"),
        "values",
        F.coalesce(metadata, F.parse_json(F.lit("{}"))).alias("metadata"),
        *(["ordinal"] if "ordinal" in df.columns else []),
    )


def reject_reason(dimension: int) -> Column:
    """What is wrong with a record of an index of this dimension; null for a good one."""
    return (
        F.when(F.col("id").isNull() | (F.col("id") == ""), "missing id")
        .when(F.col("values").isNull(), "missing values")
        .when(F.size("values") != dimension, "wrong dimension")
        .when(F.exists("values", lambda x: x.isNull() | F.isnan(x)), "not a number")
    )


def contract(df: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """Split into records of the index dimension and rejects with a reason."""
    checked = df.withColumn("reject_reason", reject_reason(dimension))
    good = checked.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return good, checked.where(F.col("reject_reason").isNotNull())


def last_per_key(incoming: DataFrame) -> DataFrame:
    """One record per (namespace, id): the last by ``ordinal`` where there is one.

    Reduced inside each task before the shuffle, so a much repeated id stays small.
    """
    order = F.col("ordinal") if "ordinal" in incoming.columns else F.lit(0)
    record = F.struct("document_id", "values", "metadata")
    return (
        incoming.groupBy(*KEY)
        .agg(F.max_by(record, order).alias("r"))
        .select(*KEY, "r.document_id", "r.values", "r.metadata")
    )


def upsert(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Base without the incoming keys, plus the incoming records."""
    fresh = last_per_key(incoming)
    kept = base.join(fresh.select(*KEY), KEY, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def in_namespace(df: DataFrame, namespace: str | None, settings: Settings = DEFAULTS) -> DataFrame:
    return df.where(F.col("namespace") == (namespace or settings.namespace))


def fetch(vectors: DataFrame, ids: DataFrame, namespace: str | None = None,
          settings: Settings = DEFAULTS) -> DataFrame:
    """Records with the given ids (column ``id``); unknown ids are absent."""
    return in_namespace(vectors, namespace, settings).join(ids.select("id"), "id", "left_semi")


def deletion(
    vectors: DataFrame,
    ids: DataFrame | None = None,
    condition: Mapping[str, Any] | None = None,
    namespace: str | None = None,
    delete_all: bool = False,
    settings: Settings = DEFAULTS,
) -> DataFrame | None:
    """Records of one namespace to delete, or None where nothing was asked for.

    ``delete_all`` comes before ``ids``, ``ids`` before ``condition``.
    """
    scope = in_namespace(vectors, namespace, settings)
    if delete_all:
        return scope
    if ids is not None:
        return scope.join(ids.select("id"), "id", "left_semi")
    if condition:
        return scope.where(record_filter(condition, vectors))
    return None


def delete(vectors: DataFrame, ids: DataFrame | None = None,
           condition: Mapping[str, Any] | None = None, namespace: str | None = None,
           delete_all: bool = False, settings: Settings = DEFAULTS) -> DataFrame:
    """What remains. Other namespaces are never touched; a filter costs no shuffle."""
    ours = F.coalesce(F.col("namespace") == (namespace or settings.namespace), F.lit(False))
    if delete_all:
        return vectors.where(~ours)
    if ids is not None:
        keys = ids.select("id", F.lit(namespace or settings.namespace).alias("namespace"))
        return vectors.join(keys, KEY, "left_anti")
    if condition:
        matched = F.coalesce(record_filter(condition, vectors), F.lit(False))
        return vectors.where(~(ours & matched))
    return vectors


def delete_by_document(vectors: DataFrame, document_id: str, namespace: str | None = None,
                       settings: Settings = DEFAULTS) -> DataFrame:
    condition = {"document_id": {"$eq": document_id}}
    return delete(vectors, condition=condition, namespace=namespace, settings=settings)


def index_stats(vectors: DataFrame, dimension: int | None = None) -> DataFrame:
    """Vector count and dimension per namespace; the row without a namespace is the total.

    Where the dimension is known no vector is read: the count needs partition columns only.
    """
    width = F.max(F.size("values")) if dimension is None else F.lit(dimension)
    spaces = vectors.groupBy("namespace").agg(
        F.count(F.lit(1)).alias("vector_count"), width.alias("dimension")
    )
    return spaces.rollup("namespace").agg(
        F.sum("vector_count").alias("vector_count"), F.max("dimension").alias("dimension")
    )
