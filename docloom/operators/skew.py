"""Joins and rankings that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import DEFAULTS, Settings


def join_to_unique(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread_by: Sequence[str],
    how: str = "inner",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Join ``left`` (keys repeat) to ``right`` (one row per key).

    Keys with many left rows are split over salts and the matching right row is
    repeated once per salt. The list of hot keys is a top-n of a pre-aggregated
    count, so its size is bounded and it is broadcast; every other key has few
    rows and goes through the ordinary shuffle. ``spread_by`` names left columns
    that differ between rows of one key.
    """
    hot = (
        left.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_copies"))
        .where(F.col("_copies") > settings.rows_per_salt)
        .orderBy(F.desc("_copies"), key)
        .limit(settings.max_hot_keys)
        .select(
            key,
            F.least(
                F.ceil(F.col("_copies") / settings.rows_per_salt), F.lit(settings.max_salts)
            ).alias("_salts"),
        )
    )
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    salted_left = (
        left.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*spread_by), salts))
        .drop("_salts")
    )
    salted_right = (
        right.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
        .drop("_salts")
    )
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")


def top_n(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int | Column,
    spread_by: Sequence[str],
    rank: str = "rank",
    at_most: int | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """First ``n`` rows per key, ranked from 1.

    Ranked twice: first inside salted slices of the key, so that no task sorts a
    whole hot key, then over the at most n × salts survivors. Where ``n`` is a column,
    ``at_most`` gives its largest value: a constant limit lets Spark drop rows before
    they are shuffled.
    """
    limit = F.lit(n) if isinstance(n, int) else n
    kept = F.col(rank) <= limit
    if at_most is not None:
        kept = kept & (F.col(rank) <= at_most)
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(settings.top_n_salts))
    sliced = Window.partitionBy(*keys, "_slice").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_slice", spread)
        .withColumn(rank, F.row_number().over(sliced))
        .where(kept)
        .withColumn(rank, F.row_number().over(whole))
        .where(kept)
        .drop("_slice")
    )
