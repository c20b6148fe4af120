"""Metadata filters: a nested dict of field conditions becomes one boolean Column."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_, eq, ge, gt, le, lt, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class Field:
    """How one metadata field is read for comparison with a Python value."""

    def __init__(self, present: Column, compared: Callable[[Callable, Any], Column], any_of: Callable):
        self.present, self.compared, self.any_of = present, compared, any_of


def column_field(column: Column) -> Field:
    """A promoted column: predicates on it reach the scan."""
    def any_of(values) -> Column:
        values = list(values)
        return column == values[0] if len(values) == 1 else column.isin(values)

    return Field(column.isNotNull(), lambda op, value: op(column, F.lit(value)), any_of)


def variant_field(metadata: Column, name: str) -> Field:
    """A key of an open VARIANT. Values only compare with values of their own kind; a list
    of strings matches where one of its members does."""
    path = f"$.{name}" if name.isidentifier() else "$['" + name.replace("'", "\\'") + "']"
    raw = F.try_variant_get(metadata, path, "variant")
    kind = F.schema_of_variant(raw)

    def read(as_type: str) -> Column:
        return F.try_variant_get(metadata, path, as_type)

    def compared(op: Callable, value: Any) -> Column:
        if isinstance(value, bool):
            return F.when(kind == "BOOLEAN", op(read("boolean"), F.lit(value)))
        if isinstance(value, (int, float)):
            numeric = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
            close = op(read("double"), F.lit(float(value)))
            if value != value or abs(value) >= 1 << 63 or value != int(value):
                return F.when(numeric, close)
            # Doubles tell whole numbers apart up to 2^53 only.
            exact = op(read("bigint"), F.lit(int(value)).cast("long"))
            return F.when(kind == "BIGINT", exact).when(numeric, close)
        return F.when(kind == "STRING", op(read("string"), F.lit(value)))

    def any_of(values) -> Column:
        values = list(values)
        scalar = reduce(or_, [compared(eq, v) for v in values], F.lit(False))
        strings = [v for v in values if isinstance(v, str)]
        if not strings:
            return scalar
        listed = F.arrays_overlap(read("array<string>"), F.array(*[F.lit(s) for s in strings]))
        return F.when(kind.startswith("ARRAY"), listed).otherwise(scalar)

    return Field(raw.isNotNull(), compared, any_of)


def _condition(field: Field, operator: str, operand: Any) -> Column:
    if operator == "$exists":
        return field.present if operand else ~field.present
    if operator in ("$eq", "$in"):
        return field.any_of([operand] if operator == "$eq" else operand)
    if operator in ("$ne", "$nin"):
        matched = field.any_of([operand] if operator == "$ne" else operand)
        return field.present & ~F.coalesce(matched, F.lit(False))
    compare = {"$gt": gt, "$gte": ge, "$lt": lt, "$lte": le}
    if operator not in compare:
        raise ValueError(f"unknown filter operator {operator!r}")
    return field.compared(compare[operator], operand)


def metadata_filter(
    condition: Mapping[str, Any] | None,
    metadata: Column | None = None,
    promoted: Mapping[str, Column] | None = None,
) -> Column:
    """``{"field": {"$eq": 1}, "$or": [...]}`` as a Column for ``where``.

    It may be null where it does not hold: a plain comparison can be pushed into the
    scan, one wrapped against nulls cannot. A bare value means ``$eq``; several entries must all hold; a missing field matches
    only ``{"$exists": false}``. Fields in ``promoted`` are read from their own column,
    the rest from the VARIANT ``metadata``.
    """
    promoted = promoted or {}
    parts: list[Column] = []
    for name, spec in (condition or {}).items():
        if name in ("$and", "$or"):
            branches = [metadata_filter(b, metadata, promoted) for b in spec]
            joined = reduce(and_ if name == "$and" else or_, branches, F.lit(name == "$and"))
            parts.append(joined)
            continue
        if name.startswith("$"):
            raise ValueError(f"unknown filter operator {name!r}")
        if name in promoted:
            field = column_field(promoted[name])
        elif metadata is not None:
            field = variant_field(metadata, name)
        else:
            raise ValueError(f"no column for filter field {name!r}")
        spec = spec if isinstance(spec, Mapping) else {"$eq": spec}
        parts += [_condition(field, op, operand) for op, operand in spec.items()]
    return reduce(and_, parts, F.lit(True))


def one_of(column: str, values: Sequence[str | None]) -> Column:
    """Whether a string column has one of ``values``: a single expression, however many."""
    quoted = [v.replace("\\", "\\\\").replace("'", "\\'") for v in values if v is not None]
    return F.expr(f"`{column}` in ('" + "', '".join(quoted) + "')") if quoted else F.lit(False)
