"""Vector arithmetic on ARRAY columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(v: Column) -> Column:
    """Unit-length copy; a zero vector stays as it is."""
    from docloom.functions.arrays import let

    return let(
        norm(v),
        lambda n: F.when(n == 0, v).otherwise(
            F.transform(v, lambda x: (x.cast("double") / n).cast("float"))
        ),
    )


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine in -1..1; 0.0 where either vector has no length."""
    from docloom.functions.arrays import let

    return let(
        norm(a) * norm(b),
        lambda n: F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n),
    )


def dimension(v: Column) -> Column:
    return F.size(v)
