"""Batch semantic search: queries in, hits, sources and totals out."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import DEFAULTS, Settings
from docloom.operators.embedding import Embedder, embed
from docloom.operators.nearest import nearest
from docloom.operators.vectors import in_namespace, record_filter
from docloom.sources.vector_table import VectorTable

TOKENS = "[a-z0-9]+"


def embed_queries(queries: DataFrame, embedder: Embedder, settings: Settings = DEFAULTS) -> DataFrame:
    """Queries are embedded like any text; there is no prefix."""
    return queries.withColumn("query_vector", embed(F.col("query"), embedder, settings))


def shape_hits(
    ranked: DataFrame, vectors: DataFrame | VectorTable, include_metadata: bool = True
) -> DataFrame:
    """Result fields of the few winners, read from their records afterwards.

    The scan that scores reads ids and values only; metadata is joined for the winners.
    """
    key = ["namespace", "id"]
    if not include_metadata:
        return ranked.select(
            "query_id",
            "rank",
            F.lit("").alias("document_id"),
            F.col("id").alias("chunk_id"),
            F.lit("").alias("content"),
            "score",
            F.lit(None).cast("variant").alias("metadata"),
            F.lit(None).cast("int").alias("page_number"),
            F.lit(None).cast("string").alias("section_title"),
        )
    meta = F.col("metadata")
    if isinstance(vectors, VectorTable):
        joined = vectors.lookup(ranked, "metadata")
    else:
        joined = ranked.join(vectors.select(*key, "metadata"), key)
    return joined.select(
        "query_id",
        "rank",
        F.coalesce(F.try_variant_get(meta, "$.document_id", "string"), F.lit("")).alias(
            "document_id"
        ),
        F.col("id").alias("chunk_id"),
        F.coalesce(F.try_variant_get(meta, "$.content", "string"), F.lit("")).alias("content"),
        "score",
        meta.alias("metadata"),
        F.try_variant_get(meta, "$.page_number", "int").alias("page_number"),
        F.try_variant_get(meta, "$.section_title", "string").alias("section_title"),
    )


def search(
    vectors: DataFrame | VectorTable,
    query_vector: list[float],
    top_k: int | None = None,
    namespace: str | None = None,
    condition: Mapping[str, Any] | None = None,
    include_metadata: bool = True,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """One query vector against one namespace."""
    records = _records(vectors)
    scope = in_namespace(records, namespace, settings).where(record_filter(condition, records))
    query = records.sparkSession.createDataFrame(
        [(0, [float(x) for x in query_vector], namespace, top_k)],
        "query_id INT, query_vector ARRAY<DOUBLE>, namespace STRING, top_k INT",
    )
    ranked = nearest(scope, query, len(query_vector), settings)
    return shape_hits(ranked, vectors, include_metadata).drop("query_id")


def _records(vectors: DataFrame | VectorTable) -> DataFrame:
    return vectors.read() if isinstance(vectors, VectorTable) else vectors


def semantic_search(
    queries: DataFrame,
    vectors: DataFrame | VectorTable,
    embedder: Embedder,
    condition: Mapping[str, Any] | None = None,
    include_metadata: bool = True,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Hits per query: text ``query`` with optional namespace, top_k and threshold."""
    floor = F.lit(settings.similarity_threshold)
    if "similarity_threshold" in queries.columns:
        floor = F.coalesce(F.col("similarity_threshold").cast("double"), floor)
    queries = queries.withColumn("similarity_threshold", floor)
    records = _records(vectors)
    scope = records.where(record_filter(condition, records)) if condition else records
    ranked = nearest(scope, embed_queries(queries, embedder, settings), embedder.dimension, settings)
    return shape_hits(ranked, vectors, include_metadata)


def totals(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """``total_results`` per query; queries without hits stay, with 0."""
    counted = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    return queries.join(counted, "query_id", "left").select(
        *queries.columns, F.coalesce("_n", F.lit(0)).alias("total_results")
    )


def rerank(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Order a query's hits by the share of its distinct tokens found in the chunk, then
    by score and id. Each query has at most its top_k hits, so groups stay small."""
    def tokens(column: str):
        return F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(TOKENS), 0))

    joined = hits.join(queries.select("query_id", "query"), "query_id")
    wanted = tokens("query")
    share = F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(wanted, tokens("content"))) / F.size(wanted)
    )
    order = Window.partitionBy("query_id").orderBy(
        F.desc("rerank_score"), F.desc("score"), F.asc("chunk_id")
    )
    return (
        joined.withColumn("rerank_score", share)
        .withColumn("rank", F.row_number().over(order))
        .drop("query")
    )


def sources(hits: DataFrame, catalog: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Source references of the hits, with the document's name from the catalog."""
    names = catalog.select("document_id", F.col("filename").alias("document_name"))
    return hits.join(names, "document_id").select(
        "query_id",
        "rank",
        "document_id",
        "document_name",
        "page_number",
        "section_title",
        F.substring("content", 1, settings.snippet_chars).alias("snippet"),
        F.col("score").alias("relevance_score"),
    )
