"""The stored embedding cache: insert-only Parquet by key prefix and insertion batch.

An entry is written once: a batch inserts only texts that no other batch holds, so reading
needs no grouping. Looking up a batch opens the partitions of its own key prefixes. Writing a
batch again replaces its own partitions, so a retried batch leaves no copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import DEFAULTS, Settings
from docloom.operators import embedding as ops
from docloom.operators.filters import one_of
from docloom.schemas import EMBEDDING_CACHE
from docloom.session import delete_path, path_exists

_STORED = f"{EMBEDDING_CACHE}, prefix STRING"


class CacheTable:
    def __init__(self, spark: SparkSession, path: str, settings: Settings = DEFAULTS):
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings

    def _prefix(self) -> Column:
        return F.substring("text_key", 1, self.settings.cache_prefix_digits)

    def _stored(self) -> DataFrame:
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], _STORED)
        return self.spark.read.schema(_STORED).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop("prefix")

    def _write(self, entries: DataFrame) -> None:
        (
            entries.withColumn("prefix", self._prefix())
            .hint("rebalance", "prefix")
            .sortWithinPartitions("prefix", "inserted_seq", "text_key")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("prefix", "inserted_seq")
            .parquet(self.path)
        )

    def insert(self, entries: DataFrame) -> None:
        """Add entries; of several for one key the first inserted stays, and keys that another
        batch holds are left out."""
        first = ops.cache_entries(entries)
        known = self.read().select("text_key", F.col("inserted_seq").alias("_seq"))
        other = (first["text_key"] == known["text_key"]) & (first["inserted_seq"] != known["_seq"])
        self._write(first.join(known, other, "left_anti"))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The entries of ``keys`` (column text_key).

        Up to ``pushed_ids`` keys go into the scan as a filter, with the prefixes they lie in;
        more of them meet the entries in a semi-join.
        """
        keys = keys.select("text_key").distinct()
        few = [r["text_key"] for r in keys.limit(self.settings.pushed_ids + 1).collect()]
        if len(few) > self.settings.pushed_ids:
            keyed = keys.withColumn("prefix", self._prefix())
            return self._stored().join(keyed, ["prefix", "text_key"], "left_semi").drop("prefix")
        digits = self.settings.cache_prefix_digits
        prefixes = sorted({k[:digits] for k in few if k})
        own = one_of("prefix", prefixes) & one_of("text_key", few)
        return self._stored().where(own).drop("prefix")

    def embed_texts(self, df: DataFrame, text: str, embedder: ops.Embedder, seq: int,
                    spread_by: list[str], now: Column | None = None) -> DataFrame:
        """Encode what the cache lacks, store it, and give every row its vector."""
        if not self.settings.cache_enabled:
            return ops.with_embedding(df, text, embedder, settings=self.settings)
        now = F.current_timestamp() if now is None else now
        texts = ops.distinct_texts(df, text)
        if path_exists(self.spark, self.path):
            # A retry of this batch must see the same cache as its first attempt.
            known = self._stored().where(F.col("inserted_seq") != seq)
            known = known.select("prefix", "text_key")
            texts = texts.withColumn("prefix", self._prefix()).join(known, ["prefix", "text_key"], "left_anti")
        self._write(ops.encode_texts(texts, embedder, seq, now, self.settings))
        return ops.attach_embeddings(df, text, self.read(), spread_by, self.settings)

    def compact(self, target: str, now: Column | None = None) -> "CacheTable":
        """A copy at ``target`` without expired and evicted entries."""
        entries = self.read()
        if now is not None:
            entries = ops.fresh_entries(entries, now, self.settings)
        compacted = CacheTable(self.spark, target, self.settings)
        compacted._write(ops.evict_oldest(entries, self.settings))
        return compacted

    def clear(self) -> int:
        """Remove all entries and return how many there were; no vector is read."""
        count = self.read().count()
        delete_path(self.spark, self.path)
        return count
