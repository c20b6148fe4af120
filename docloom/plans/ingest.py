"""Ingest: files or texts to catalog, chunks and vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.config import DEFAULTS, Settings
from docloom.functions import text as tx
from docloom.operators import catalog as cat
from docloom.operators.chunking import chunk_texts
from docloom.operators.embedding import Embedder
from docloom.operators.pii import pii_report
from docloom.operators.sections import section_nodes
from docloom.operators.vectors import vector_records
from docloom.schemas import STORED_CATALOG
from docloom.session import path_exists, shared_folder
from docloom.sources.cache_table import CacheTable
from docloom.sources.files import extract
from docloom.sources.ledger import Ledger
from docloom.sources.vector_table import VectorTable


def prepare(documents: DataFrame, redact: bool = True, nodes: bool = False,
            processed_at: Column | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Redact, then chunk. One narrow stage: every column comes from the document's row.

    Personal data is removed before chunking, so no chunk or vector holds it.
    """
    at = F.current_timestamp() if processed_at is None else processed_at
    out = documents.withColumn("pii", pii_report(F.col("content"), settings=settings))
    if redact:
        out = out.withColumn("content", F.col("pii.redacted_content"))
    out = out.withColumn("pii", F.struct("pii.has_pii", "pii.categories_found"))
    out = out.withColumn("chunks", chunk_texts(F.col("content"), settings=settings))
    if nodes:
        out = out.withColumn("nodes", section_nodes(F.col("content"), settings))
    return out.withColumn("processed_at", at)


def chunk_rows(prepared: DataFrame) -> DataFrame:
    """Chunk records from the chunk arrays of prepared documents."""
    rows = prepared.select(
        "document_id", "metadata", F.posexplode("chunks").alias("chunk_index", "content")
    )
    return rows.select(
        tx.chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"),
        "document_id",
        "content",
        "chunk_index",
        F.length("content").alias("char_count"),
        tx.word_count(F.col("content")).alias("word_count"),
        F.col("metadata").withField("chunk_index", F.col("chunk_index")).alias("metadata"),
    )


@dataclass
class KnowledgeBase:
    """The tables of one document collection, below one folder.

    A batch is named by ``run`` (the source it comes from) and its number there. The ledger
    gives it its place in the order of all batches; every table keeps the batch's rows under
    that number. A batch that breaks is run again and replaces its own rows only; one that is
    closed in the ledger has no second effect.
    """

    spark: SparkSession
    root: str
    embedder: Embedder
    buckets: int = 16
    nodes: bool = False
    settings: Settings = DEFAULTS

    @property
    def vectors(self) -> VectorTable:
        return VectorTable(
            self.spark, f"{self.root}/vectors", self.embedder.dimension, self.buckets, self.settings
        )

    @property
    def cache(self) -> CacheTable:
        return CacheTable(self.spark, f"{self.root}/cache", self.settings)

    @property
    def ledger(self) -> Ledger:
        return Ledger(self.spark, f"{self.root}/ledger")

    def _stored(self, name: str, schema: str | None = None) -> DataFrame:
        read = self.spark.read.schema(schema) if schema else self.spark.read
        return read.parquet(f"{self.root}/{name}")

    def _live(self, name: str, schema: str | None = None) -> DataFrame:
        """Stored rows without those of documents deleted in their batch or later."""
        rows = self._stored(name, schema)
        if not path_exists(self.spark, f"{self.root}/deleted"):
            return rows
        until = self._stored("deleted").groupBy("document_id").agg(F.max("seq").alias("_until"))
        dead = (rows["document_id"] == until["document_id"]) & (rows["seq"] <= until["_until"])
        return rows.join(until, dead, "left_anti")

    def catalog(self) -> DataFrame:
        """One row per document, from its last batch; copies inside it are the same document.

        Read from the narrow catalog table that ingest writes: no chunk or text is touched.
        """
        if not path_exists(self.spark, f"{self.root}/catalog"):
            return self.spark.createDataFrame([], STORED_CATALOG)
        rows = self._live("catalog", f"{STORED_CATALOG}, seq BIGINT")
        order = F.struct("seq", "created_at")
        return cat.latest(rows.withColumn("version", order).drop("seq"), "version")

    def chunks(self) -> DataFrame:
        """One row per chunk id; a document ingested again has the same chunks."""
        return self._live("chunks").drop("seq").dropDuplicates(["chunk_id"])

    def _replace(self, df: DataFrame, name: str, seq: int) -> DataFrame:
        path = f"{self.root}/{name}"
        (
            df.withColumn("seq", F.lit(seq).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("seq")
            .parquet(path)
        )
        schema = T.StructType([*df.schema.fields, T.StructField("seq", T.LongType())])
        return self.spark.read.schema(schema).parquet(path).where(F.col("seq") == seq)

    def ingest_files(self, raw: DataFrame, batch: int, namespace: str | None = None,
                     run: str = "default") -> int:
        return self.ingest(extract(raw), batch, namespace, run)

    def ingest(self, documents: DataFrame, batch: int, namespace: str | None = None,
               run: str = "default") -> int:
        """Run one batch of extracted documents. Returns the number of vectors written."""
        shared_folder(self.spark)
        entry = self.ledger.open(run, batch)
        if entry.done:
            return entry.effect
        prepared = self._replace(
            prepare(documents, nodes=self.nodes, settings=self.settings), "prepared", entry.seq
        )
        space = F.lit(namespace or self.settings.namespace).alias("namespace")
        counts = [F.col(f"metadata.{c}").alias(c) for c in ("table_count", "image_count")]
        self._replace(cat.catalog_rows(prepared, space, *counts), "catalog", entry.seq)
        # Whole documents are only shuffled where the batch really holds copies.
        copies = prepared.groupBy("document_id").count().agg(F.max("count").alias("n")).first()
        source = prepared.select("document_id", "metadata", "chunks")
        if (copies["n"] or 0) > 1:
            source = source.dropDuplicates(["document_id"])
        chunks = self._replace(chunk_rows(source), "chunks", entry.seq).drop("seq")
        embedded = self.cache.embed_texts(chunks, "content", self.embedder, entry.seq, ["chunk_id"])
        records = vector_records(embedded, namespace, self.settings)
        written = self.vectors.upsert(records, unique=True, seq=entry.seq)
        self.ledger.close(run, batch, entry.seq, written)
        return written

    def handler(self, run: str, namespace: str | None = None) -> Callable[[DataFrame, int], int]:
        """What a stream of files calls for each batch; ``run`` names the stream."""
        return lambda raw, batch: self.ingest_files(raw, batch, namespace, run)

    def delete_documents(self, ids: DataFrame, batch: int, namespace: str | None = None,
                         run: str = "default") -> DataFrame:
        """Delete documents from catalog, chunks and vectors; report per requested id.

        Catalog and chunks note the deletion with its number, so a later upload of the same
        document counts again. Vectors get deletion marks, in every namespace that has any
        unless one is named. The report is stored; the same request again returns it.
        """
        shared_folder(self.spark)
        entry = self.ledger.open(run, batch)
        if not entry.done:
            self._replace(cat.deletion_report(ids, self.catalog()), "reports", entry.seq)
        report = self._stored("reports").where(F.col("seq") == entry.seq).drop("seq")
        if not entry.done:
            keys = report.select("document_id")
            gone = self.vectors.read().join(keys, "document_id", "left_semi")
            if namespace is not None:
                gone = gone.where(F.col("namespace") == namespace)
            self.vectors.delete_keys(gone, entry.seq)
            self._replace(keys, "deleted", entry.seq)
            self.ledger.close(run, batch, entry.seq, report.count())
        return report
