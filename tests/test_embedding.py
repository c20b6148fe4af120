import hashlib
import re
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docloom.config import Settings
from docloom.operators import embedding as em
from docloom.session import work_path
from docloom.sources.cache_table import CacheTable

# The plug-in below is not installed on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Counting:
    """An embedder plug-in: length and number of capitals, not normalized."""

    dimension = 2

    def load(self):
        import numpy as np

        return lambda texts: np.array([counted(t) for t in texts])


def counted(text):
    return [len(text), sum(c.isupper() for c in text)]


def unit(text):
    v = np.array(counted(text), dtype=float)
    return list((v / np.linalg.norm(v)).astype(np.float32))


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i INT, text STRING")


def test_plug_in_keeps_row_order_over_batches(spark):
    values = [f"text {'A' * (i % 7)}" for i in range(500)]
    got = em.with_embedding(texts(spark, values), "text", Counting(), settings=Settings(encode_batch=3))
    for row in got.collect():
        assert row["embedding"] == unit(row["text"])


def test_hashed_embedding_definition(spark):
    value = "Aa bb-CC aa é9"
    expected = np.zeros(16)
    for token in re.findall("[a-z0-9]+", value.lower()):
        digest = hashlib.md5(token.encode()).hexdigest()
        expected[int(digest[:4], 16) % 16] += 1 - 2 * (int(digest[4], 16) % 2)
    expected /= np.linalg.norm(expected)
    df = texts(spark, [value, "", "é!"])
    rows = em.with_embedding(df, "text", em.HashedTokenEmbedder(16)).orderBy("i").collect()
    assert np.allclose(rows[0]["embedding"], expected)
    assert rows[1]["embedding"] == rows[2]["embedding"] == [0.0] * 16


def test_null_text_is_empty(spark):
    row = em.with_embedding(texts(spark, [None]), "text", em.HashedTokenEmbedder(4)).first()
    assert row["embedding"] == [0.0] * 4


def test_cache_reuses_and_adds(spark):
    cache = CacheTable(spark, work_path(spark, "cache"))
    first = cache.embed_texts(texts(spark, ["a", "b", "a"]), "text", Counting(), 1, ["i"])
    assert first.count() == 3 and cache.read().count() == 2
    second = cache.embed_texts(texts(spark, ["b", "c"]), "text", Counting(), 2, ["i"])
    assert sorted((r["text"], r["embedding"]) for r in second.collect()) == [("b", [1, 0]), ("c", [1, 0])]
    assert sorted(r["inserted_seq"] for r in cache.read().collect()) == [1, 1, 2]
    # The same batch once more leaves the same entries.
    cache.embed_texts(texts(spark, ["b", "c"]), "text", Counting(), 2, ["i"]).collect()
    assert sorted(r["inserted_seq"] for r in cache.read().collect()) == [1, 1, 2]
    assert spark.read.parquet(cache.path).count() == 3
    assert cache.clear() == 3 and cache.read().count() == 0


def test_cache_off_encodes_directly(spark):
    cache = CacheTable(spark, work_path(spark, "cache"), Settings(cache_enabled=False))
    got = cache.embed_texts(texts(spark, ["Aa"]), "text", Counting(), 1, ["i"])
    assert got.first()["embedding"] == unit("Aa") and cache.read().count() == 0


def test_eviction_and_time_to_live(spark):
    now = F.lit("2024-01-01 02:00:00").cast("timestamp")
    entries = spark.range(12).select(
        F.col("id").cast("string").alias("text_key"),
        F.array(F.lit(1.0).cast("float")).alias("embedding"),
        F.col("id").alias("inserted_seq"),
        (now - F.make_dt_interval(mins=(F.col("id") * 10).cast("int"))).alias("inserted_at"),
    )
    limits = Settings(cache_max_entries=11, cache_evict_entries=5)
    left = em.evict_oldest(entries, limits)
    assert sorted(r["inserted_seq"] for r in left.collect()) == list(range(5, 12))
    roomy = Settings(cache_max_entries=12, cache_evict_entries=5)
    assert em.evict_oldest(entries, roomy).count() == 12
    assert em.fresh_entries(entries, now).count() == 6
    assert em.fresh_entries(entries, now, Settings(cache_enabled=False)).count() == 0
    cache = CacheTable(spark, work_path(spark, "cache"), limits)
    cache.insert(entries)
    assert cache.compact(work_path(spark, "cache")).read().count() == 7
    assert cache.compact(work_path(spark, "cache"), now).read().count() == 6


def test_hot_text_is_salted_and_whole(spark):
    settings = Settings(rows_per_salt=50, max_salts=8)
    df = spark.range(3000).select(
        F.col("id").alias("i"),
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"),
    )
    entries = em.distinct_texts(df, "text").select(
        "text_key", em.embed(F.col("text"), Counting()).alias("embedding")
    )
    got = em.attach_embeddings(df, "text", entries, ["i"], settings)
    assert got.count() == 3000 and got.select("i").distinct().count() == 3000
    assert got.where("embedding[0] <> 1 or embedding is null").count() == 0
