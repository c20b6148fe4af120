"""Approximate search over inverted lists: a query scores the lists nearest to it only.

A coarse quantizer, fitted on a bounded sample, gives every vector the number of its nearest
centroid. That number becomes part of the namespace, so a stored table keeps each list in
partitions of its own and a search opens the probed ones; inside a task a query meets the
vectors of its probed lists only. Lists are never gathered: a large one is spread over as
many tasks as its files, like a large namespace.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import DEFAULTS, Settings
from docloom.operators.nearest import nearest, prepare_queries

if TYPE_CHECKING:
    import numpy as np

# Sampled vectors for each list. The driver holds lists x SAMPLE vectors while fitting.
SAMPLE = 64


@dataclass(frozen=True)
class Quantizer:
    """Unit-length centroids, one row for each list."""

    centroids: "np.ndarray"

    def _nearest(self, values: Column, how_many: int) -> Column:
        """Numbers of the nearest lists, the nearest first; none for unusable vectors."""
        centroids = self.centroids

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            import numpy as np

            for lists in batches:
                sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
                good = np.flatnonzero(sizes == centroids.shape[1])
                flat = lists.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False)
                scores = flat.reshape(len(good), centroids.shape[1]).astype(np.float64) @ centroids.T
                # Equal scores go to the smaller number.
                order = np.argsort(-scores, axis=1, kind="stable")[:, :how_many]
                found = np.zeros(len(lists), np.int32)
                found[good] = order.shape[1]
                edges = np.concatenate([[0], np.cumsum(found)]).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(edges), pa.array(order.ravel().astype(np.int32)))

        return F.arrow_udf(run, "array<int>")(values)

    def list_of(self, values: Column) -> Column:
        return F.coalesce(F.get(self._nearest(values, 1), F.lit(0)), F.lit(-1))

    def probes_of(self, values: Column, probes: int) -> Column:
        return self._nearest(values, probes)


def fit(vectors: DataFrame, dimension: int, lists: int, rounds: int = 8,
        sample: int = SAMPLE) -> Quantizer:
    """Centroids by k-means on the direction of at most ``lists * sample`` vectors.

    The sample is drawn by a hash of the id, so it is the same in every run. Lists that
    attract nothing keep the vector they started from.
    """
    import numpy as np

    usable = vectors.where(F.size("values") == dimension)
    wanted, total = lists * sample, usable.count()
    if total > wanted:
        share = F.pmod(F.xxhash64("namespace", "id"), F.lit(1 << 20))
        usable = usable.where(share < int((1 << 20) * min(1.0, 1.2 * wanted / total)) + 1)
    rows = usable.select("values", F.xxhash64("id", "namespace").alias("h"))
    table = rows.orderBy("h").limit(wanted).toArrow()
    flat = table.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    points = flat.astype(np.float64).reshape(-1, dimension)
    if not len(points):
        return Quantizer(np.zeros((1, dimension)))

    def unit(matrix):
        length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        return matrix / np.where(length == 0, 1.0, length)

    points = unit(points)
    centroids = points[:lists].copy()
    for _ in range(rounds):
        own = np.argmax(points @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        filled = np.bincount(own, minlength=len(centroids)) > 0
        centroids[filled] = unit(sums[filled])
    return Quantizer(centroids)


def _sub_namespace(namespace: Column, number: Column) -> Column:
    return F.concat_ws("#", namespace, number.cast("string"))


def by_list(vectors: DataFrame, quantizer: Quantizer) -> DataFrame:
    """Vectors with their list folded into the namespace, ready to be stored. Narrow."""
    number = quantizer.list_of(F.col("values"))
    return vectors.withColumn("namespace", _sub_namespace(F.col("namespace"), number))


def nearest_probed(listed: DataFrame, queries: DataFrame, quantizer: Quantizer, probes: int,
                   settings: Settings = DEFAULTS) -> DataFrame:
    """Like ``nearest`` over the output of ``by_list``, scoring the probed lists only."""
    dimension = quantizer.centroids.shape[1]
    asked = prepare_queries(queries, settings).withColumn(
        "_list", F.explode(quantizer.probes_of(F.col("query_vector"), probes))
    )
    asked = asked.withColumn("namespace", _sub_namespace(F.col("namespace"), F.col("_list")))
    hits = nearest(listed, asked.drop("_list"), dimension, settings)
    return hits.withColumn("namespace", F.regexp_replace("namespace", r"#-?[0-9]+$", ""))
