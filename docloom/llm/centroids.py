"""Centroid clustering on an incremental distance matrix of exact integers.

Components become the integers floor(64 x). A vector keeps its dot products with all
centroids, exact 64-bit integers stored beside it. When the centroids have moved, a dot
product changes only by the components of its centroid that changed:
``dot += sum(v[i] * (new[i] - old[i]))`` over the nonzero changes. The squared distance is
``|v|^2 - 2 dot + |c|^2``, and since ``|v|^2`` is the same for all centroids of a vector, the
argmin needs the dots and the centroids' own squares only.

Each round reads the stored state once, writes the next one and sums the members of every
cluster inside each task; k x (dimension + 1) numbers reach the driver, whatever the number
of vectors. A state is deleted as soon as the next one is written. Nothing is shuffled but
those sums, so a cluster that holds most vectors costs no more than any other.

Vectors that are null, of another length, or hold null or non-finite components are left out.
Components of more than 2^26 after scaling raise an error: their distances do not fit a long.
Repeated rows each count and get a row each. Centroids start as the vectors with the smallest
hash of their id; rows with equal ids go by their components. With fewer vectors than k there
are as many centroids as vectors; an empty table gives no rows. Ties go to the smaller number.
Null ids count as empty text in the hash. Other columns are neither read nor kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import stored
from docloom.session import delete_path, work_path

SCALE = 64
MOST = 1 << 26
_STATE = "vec_id long, v array<int>, dots array<long>, cluster int"
_SUMS = "cluster int, place int, n long"


def integer_vectors(vectors: DataFrame, dimension: int, vec_id: str = "vec_id",
                    values: str = "embedding") -> DataFrame:
    """``vec_id, v``: usable vectors with components floor(64 x)."""
    x = F.col(values)
    finite = F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf"))
    )
    scaled = F.transform(x, lambda e: F.floor(e.cast("double") * SCALE))
    small = F.when(F.abs(F.array_max(F.transform(scaled, F.abs))) <= MOST, scaled)
    error = F.raise_error(F.lit(f"a component beyond {MOST} after scaling by {SCALE}"))
    return vectors.where((F.size(x) == dimension) & finite).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.coalesce(small, error).cast("array<int>").alias("v"),
    )


def first_centroids(integers: DataFrame, k: int, seed: str = "1") -> np.ndarray:
    """The k vectors with the smallest hash of their id, in its order: at most k rows."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = integers.select("v", F.sha2(name, 256).alias("h")).orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    edges = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(matrix.ravel(), kind))


def _state(ids: pa.Array, vectors: np.ndarray, dots: np.ndarray, squares: np.ndarray) -> pa.RecordBatch:
    # argmin takes the first of equal values, the smaller number.
    cluster = np.argmin(squares - 2 * dots, axis=1).astype(np.int32)
    columns = [ids, _lists(vectors, pa.int32()), _lists(dots, pa.int64()), pa.array(cluster)]
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "dots", "cluster"])


def _first_state(integers: DataFrame, centroids: np.ndarray) -> DataFrame:
    k, width = centroids.shape
    squares = (centroids * centroids).sum(axis=1)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("v"), width)
            yield _state(batch.column("vec_id"), vectors, vectors @ centroids.T, squares)

    return integers.mapInArrow(task, _STATE)


def _next_state(state: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """Dots moved on by the components of each centroid that changed, and the new argmin."""
    k, width = new.shape
    squares = (new * new).sum(axis=1)
    change = new - old
    moved = [(j, at, change[j, at]) for j in range(k) if len(at := np.flatnonzero(change[j]))]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("v"), width)
            dots = _matrix(batch.column("dots"), k)
            for j, at, by in moved:
                dots[:, j] += vectors[:, at] @ by
            yield _state(batch.column("vec_id"), vectors, dots, squares)

    return state.mapInArrow(task, _STATE)


def _moved_centroids(state: DataFrame, old: np.ndarray) -> np.ndarray:
    """floor(sum / count) of every cluster's members; an empty cluster stays."""
    k, width = old.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last column counts.
        total = np.zeros((k, width + 1), np.int64)
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            vectors = _matrix(batch.column("v"), width)
            for j in np.unique(cluster):
                own = vectors[cluster == j]
                total[j, :width] += own.sum(axis=0)
                total[j, width] += len(own)
        j, place = np.nonzero(total)
        columns = [pa.array(j, pa.int32()), pa.array(place, pa.int32()), pa.array(total[j, place])]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "place", "n"])

    partial = state.select("v", "cluster").mapInArrow(task, _SUMS)
    # k x (dimension + 1) rows at most, with room for sums beyond a long.
    rows = partial.groupBy("cluster", "place").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n"))
    sums = np.zeros((k, width + 1), object)
    for r in rows.collect():
        sums[r["cluster"], r["place"]] = int(r["n"])
    new = old.copy()
    for j in range(k):
        if sums[j, width]:
            new[j] = [s // sums[j, width] for s in sums[j, :width]]
    return new


def centroid_clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dimension: int = 64,
                      seed: str = "1", vec_id: str = "vec_id", values: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid``."""
    spark = vectors.sparkSession
    integers = integer_vectors(vectors, dimension, vec_id, values)
    centroids = first_centroids(integers, k, seed)
    if not len(centroids):
        centroids = np.zeros((1, dimension), np.int64)
    path = work_path(spark, "centroid-state")
    _first_state(integers, centroids).write.parquet(path)
    for _ in range(rounds):
        state = spark.read.schema(_STATE).parquet(path)
        new = _moved_centroids(state, centroids)
        following = work_path(spark, "centroid-state")
        _next_state(state, centroids, new).write.parquet(following)
        delete_path(spark, path)
        path, centroids = following, new
    state = spark.read.schema(_STATE).parquet(path)

    # One row for each centroid.
    known = spark.createDataFrame(
        [
            (j, c.tolist(), int((c * c).sum()),
             hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
            for j, c in enumerate(centroids)
        ],
        "cluster int, centroid array<long>, square long, centroid_sha256 string",
    )
    own = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    dot = F.element_at("dots", F.col("cluster") + 1)
    placed = stored(
        state.join(F.broadcast(known), "cluster").select(
            "vec_id", "cluster", (own - 2 * dot + F.col("square")).alias("distance"),
            "centroid_sha256",
        ),
        "centroid-clusters",
    )
    delete_path(spark, path)
    total = F.sum(F.col("distance").cast("decimal(20,0)"))
    sums = placed.groupBy("cluster").agg(total.alias("s"))
    inertia = sums.agg(F.sum("s").cast("long").alias("inertia"))
    by_cluster = sums.select("cluster", F.col("s").cast("long").alias("cluster_inertia"))
    # k rows and one row; the centroids themselves are rows of `known`.
    return (
        placed.join(F.broadcast(by_cluster), "cluster")
        .join(F.broadcast(known.select("cluster", "centroid")), "cluster")
        .withColumn("inertia", inertia.scalar())
        .select(
            "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256",
            "centroid",
        )
    )
