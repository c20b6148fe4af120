"""Connected components by alternating large-star and small-star rounds.

Every round is two groupings with map-side minima and two joins over the edges, written to
the shared folder; the driver sees one checksum per round. Stars shrink distances fast, so
few rounds are needed whatever the components' shapes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import stored

# Keys as rows of a hash table: the columns and about 40 bytes.
BROADCAST_BYTES = 64 << 20


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id that has an edge; component is its smallest id.

    ``edges`` has columns ``a`` and ``b`` of type long. Loops and nulls are left out.
    """
    now = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    now, before = stored(now.distinct(), "edges"), None
    while True:
        state = now.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        # Large star: everything above a node moves to the node's least neighbour.
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a")
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and all below it move to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = moved.union(low.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b"))
        now = stored(small.distinct(), "edges")
    found = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found.union(now.select("b", "b").distinct())


def only(docs: DataFrame, ids: DataFrame, how: str, key: str | list[str] = "doc_id") -> DataFrame:
    """Semi or anti join of wide rows with a list of distinct ids.

    A list of up to ``BROADCAST_BYTES`` goes to every task, so that the wide rows stay where
    they are; a longer one meets them in an ordinary shuffled join. Keys are of fixed width.
    """
    size = ids.count() * (8 * len(ids.columns) + 40)
    return docs.join(F.broadcast(ids) if size <= BROADCAST_BYTES else ids, key, how)
