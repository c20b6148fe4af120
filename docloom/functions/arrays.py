"""Array helpers built from higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    A plain Column would be evaluated again at every place it is used, and once
    per element inside a lambda.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def cut_blocks(values: Column) -> Column:
    """The array as an array of consecutive blocks."""
    last = F.greatest(F.ceil(F.size(values) / BLOCK).cast("int") - 1, F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), last), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK))
    )


def fold_closing(
    values: Column, opened: Column, closed_type: str, add: Callable[[Column, Column], Column]
) -> Column:
    """STRUCT<open, closed> of a fold that now and then closes an item.

    ``add`` maps STRUCT<open, closed> and a value to the next one. Spark copies the
    state at every step, all closed items included, so they are gathered per block.
    """

    def over(blocks: Column) -> Column:
        def step(acc: Column, block: Column) -> Column:
            start = F.struct(
                acc["open"].alias("open"),
                F.array().cast(f"array<{closed_type}>").alias("closed"),
            )
            return let(
                F.aggregate(block, start, add),
                lambda r: F.struct(
                    r["open"].alias("open"),
                    F.array_append(acc["done"], r["closed"]).alias("done"),
                ),
            )

        begin = F.struct(
            opened.alias("open"), F.array().cast(f"array<array<{closed_type}>>").alias("done")
        )
        return F.aggregate(
            blocks,
            begin,
            step,
            lambda acc: F.struct(
                acc["open"].alias("open"), F.flatten(acc["done"]).alias("closed")
            ),
        )

    return let(let(values, cut_blocks), over)


def running(values: Column, start: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Exclusive running fold: element i combines ``start`` and elements before i.

    Appending to an array copies it, so one long fold costs n². Folding blocks of
    fixed size and then shifting each block keeps it close to linear, which matters
    for a document with millions of matches.
    """

    def scan(items: Column, first: Column) -> Column:
        grown = F.aggregate(
            items,
            F.array(first),
            lambda acc, v: F.concat(acc, F.array(combine(F.element_at(acc, -1), v))),
        )
        return F.slice(grown, F.lit(1), F.size(items))

    def over_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, start, combine))
        pairs = F.arrays_zip(blocks.alias("items"), scan(totals, start).alias("first"))
        return F.flatten(F.transform(pairs, lambda p: scan(p["items"], p["first"])))

    return let(let(values, cut_blocks), over_blocks)
