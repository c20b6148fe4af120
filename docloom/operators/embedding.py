"""Embedding and its content-keyed cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import DEFAULTS, Settings
from docloom.functions.text import text_key
from docloom.operators.skew import join_to_unique


class Embedder(Protocol):
    """Plug-in encoder. ``load`` runs once per task and returns a function from a list
    of texts to a float matrix with one row per text. Rows need no unit length."""

    dimension: int

    def load(self) -> Callable[[Sequence[str]], object]: ...


class HashedTokenEmbedder:
    """Deterministic default encoder: signed token counts in hashed buckets.

    Tokens are runs of a-z and 0-9 in the lower-cased text. The first four hex digits
    of a token's MD5 choose the bucket, the parity of the fifth the sign. It is a
    feature hash, not a trained language model.
    """

    def __init__(self, dimension: int = DEFAULTS.embedding_dimension):
        self.dimension = dimension

    def load(self) -> Callable[[Sequence[str]], object]:
        import hashlib
        import re

        import numpy as np

        dimension, words, slots = self.dimension, re.compile("[a-z0-9]+"), {}

        def slot(token: str) -> int:
            digest = hashlib.md5(token.encode()).hexdigest()
            bucket = int(digest[:4], 16) % dimension
            # Odd parity counts down: kept as a second half of the bucket range.
            found = bucket + dimension * (int(digest[4], 16) % 2)
            if len(slots) >= 1_000_000:
                slots.clear()
            slots[token] = found
            return found

        def encode(texts: Sequence[str]):
            counts = np.zeros((len(texts), 2 * dimension))
            for row, text in enumerate(texts):
                found = words.findall(text.lower())
                codes = [s if (s := slots.get(t)) is not None else slot(t) for t in found]
                if codes:
                    counts[row] = np.bincount(codes, minlength=2 * dimension)
            return counts[:, :dimension] - counts[:, dimension:]

        return encode


def embed(text: Column, embedder: Embedder, settings: Settings = DEFAULTS) -> Column:
    """ARRAY<FLOAT> of unit length per text; a zero vector stays zero.

    Narrow: Arrow batches in, lists out.
    """
    step = settings.encode_batch

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        encode = embedder.load()
        for texts in batches:
            values = texts.to_pylist()
            rows = np.empty((len(values), embedder.dimension), dtype=np.float32)
            for i in range(0, len(values), step):
                part = np.asarray(encode(values[i : i + step]), dtype=np.float64)
                length = np.sqrt((part * part).sum(axis=1, keepdims=True))
                rows[i : i + step] = part / np.where(length == 0, 1, length)
            offsets = np.arange(len(values) + 1, dtype=np.int32) * embedder.dimension
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))

    encode_udf = F.arrow_udf(run, "array<float>")
    return encode_udf(F.coalesce(text, F.lit("")))


def with_embedding(df: DataFrame, text: str, embedder: Embedder, out: str = "embedding",
                   settings: Settings = DEFAULTS) -> DataFrame:
    """Embed every row directly. No shuffle; repeated texts are encoded again."""
    return df.withColumn(out, embed(F.col(text), embedder, settings))


def distinct_texts(df: DataFrame, text: str) -> DataFrame:
    """``text_key, text, copies``: copies collapse before the shuffle."""
    return df.groupBy(text_key(F.col(text)).alias("text_key"), F.col(text).alias("text")).agg(
        F.count(F.lit(1)).alias("copies")
    )


def cache_entries(cache: DataFrame) -> DataFrame:
    """One entry per key, the first inserted."""
    return cache.groupBy("text_key").agg(
        F.min_by("embedding", "inserted_seq").alias("embedding"),
        F.min("inserted_seq").alias("inserted_seq"),
        F.min("inserted_at").alias("inserted_at"),
    )


def cache_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    return texts.join(cache.select("text_key"), "text_key", "left_anti")


def mark_cached(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Hits and misses in one pass, told apart by the column ``cached``."""
    known = cache.select("text_key").distinct().withColumn("_known", F.lit(True))
    joined = texts.join(known, "text_key", "left")
    return joined.withColumn("cached", F.coalesce("_known", F.lit(False))).drop("_known")


def encode_misses(texts: DataFrame, cache: DataFrame, embedder: Embedder, seq: int,
                  inserted_at: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """New cache rows for texts the cache does not hold; ``seq`` orders insertions."""
    misses = cache_misses(texts, cache) if settings.cache_enabled else texts
    return encode_texts(misses, embedder, seq, inserted_at, settings)


def encode_texts(texts: DataFrame, embedder: Embedder, seq: int, inserted_at: Column,
                 settings: Settings = DEFAULTS) -> DataFrame:
    """Cache rows for texts known to be new."""
    return texts.select(
        "text_key",
        embed(F.col("text"), embedder, settings).alias("embedding"),
        F.lit(seq).cast("long").alias("inserted_seq"),
        inserted_at.alias("inserted_at"),
    )


def attach_embeddings(df: DataFrame, text: str, entries: DataFrame, spread_by: Sequence[str],
                      settings: Settings = DEFAULTS) -> DataFrame:
    """Give every row the vector of its text. Each row keeps its own identity, so input
    order needs no restoring; texts with very many copies are split over salts."""
    keyed = df.withColumn("text_key", text_key(F.col(text)))
    vectors = entries.select("text_key", "embedding")
    return join_to_unique(keyed, vectors, "text_key", spread_by, "left", settings).drop("text_key")


def fresh_entries(cache: DataFrame, now: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Entries younger than the time to live; none where the cache is switched off."""
    if not settings.cache_enabled:
        return cache.where(F.lit(False))
    ttl = F.make_dt_interval(secs=F.lit(settings.cache_ttl_seconds).cast("decimal(18,6)"))
    return cache.where(F.col("inserted_at") > now - ttl)


def evict_oldest(cache: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Above the entry limit, drop a fixed number of oldest entries (first in, first out)."""
    total = cache.select(F.count(F.lit(1)).alias("n")).scalar()
    oldest = (
        cache.select("text_key", "inserted_seq")
        .orderBy("inserted_seq", "text_key")
        .limit(settings.cache_evict_entries)
        .where(total > settings.cache_max_entries)
        .select("text_key")
    )
    return cache.join(F.broadcast(oldest), "text_key", "left_anti")
