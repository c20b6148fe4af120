"""Approximate search: only the cells near a query are scored.

A cell is the sign pattern of a vector against a few fixed orthogonal ±1 directions
(rows of a Walsh matrix). A query probes every cell within a given number of differing
signs. Cells act as sub-namespaces of the exact search, so a table stored by cell is
pruned to the probed ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import DEFAULTS, Settings
from docloom.operators.nearest import nearest, prepare_queries


def cell(values: Column, bits: int) -> Column:
    """Cell number of a vector: bit i is set where direction i has a positive sum."""

    def bit(i: int) -> Column:
        signed = F.transform(
            values,
            lambda x, j: F.when(
                F.bit_count(j.bitwiseAND(F.lit(i + 1))) % 2 == 0, x.cast("double")
            ).otherwise(-x.cast("double")),
        )
        total = F.aggregate(signed, F.lit(0.0), lambda a, x: a + x)
        return F.when(total > 0, F.lit(1 << i)).otherwise(F.lit(0))

    out = F.lit(0)
    for i in range(bits):
        out = out + bit(i)
    return out


def _sub_namespace(namespace: Column, number: Column) -> Column:
    return F.concat_ws("#", namespace, number.cast("string"))


def by_cell(vectors: DataFrame, bits: int) -> DataFrame:
    """Vectors with their cell folded into the namespace, ready to be stored."""
    return vectors.withColumn(
        "namespace", _sub_namespace(F.col("namespace"), cell(F.col("values"), bits))
    )


def nearest_approximate(
    celled: DataFrame,
    queries: DataFrame,
    dimension: int,
    bits: int,
    radius: int,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Like ``nearest`` over the output of ``by_cell``, looking only at probed cells."""
    flips = [m for m in range(1 << bits) if m.bit_count() <= radius]
    probes = prepare_queries(queries, settings).withColumn(
        "_own", cell(F.col("query_vector"), bits)
    )
    probes = probes.withColumn("_flip", F.explode(F.array(*[F.lit(m) for m in flips])))
    probes = probes.withColumn(
        "namespace", _sub_namespace(F.col("namespace"), F.col("_own").bitwiseXOR(F.col("_flip")))
    )
    hits = nearest(celled, probes, dimension, settings)
    return hits.withColumn("namespace", F.regexp_replace("namespace", r"#[0-9]+$", ""))


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search also found."""
    key = ["query_id", "namespace", "id"]
    found = approximate.select(*key).withColumn("_found", F.lit(1))
    return exact.join(found, key, "left").agg(
        F.count(F.lit(1)).alias("exact_hits"),
        F.count("_found").alias("found_hits"),
        (F.count("_found") / F.count(F.lit(1))).alias("recall"),
    )
