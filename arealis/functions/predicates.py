"""Predicates from a mapping of column names to conditions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DateType, StructType, TimestampNTZType, TimestampType


def _negate(condition: Column) -> Column:
    # a negated comparison keeps rows in which the field is null
    return ~F.coalesce(condition, F.lit(False))


def _literal(value: Any, kind: DataType | None) -> Column:
    """A literal; dates and times get the column's own type, so that the column needs no cast."""
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.date) and isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return F.lit(value.isoformat()).cast(kind)
    return F.lit(value)


def _equal(column: Column, value: Any, kind: DataType | None) -> Column:
    return column.isNull() if value is None else column == _literal(value, kind)


def _is_in(column: Column, values: Any, kind: DataType | None) -> Column:
    present = [_literal(v, kind) for v in values if v is not None]
    condition = column.isin(present) if present else F.lit(False)
    return condition | column.isNull() if len(present) < len(values) else condition


_COMPARE = {
    "$eq": _equal,
    "$gt": lambda c, v, kind: c > _literal(v, kind),
    "$gte": lambda c, v, kind: c >= _literal(v, kind),
    "$lt": lambda c, v, kind: c < _literal(v, kind),
    "$lte": lambda c, v, kind: c <= _literal(v, kind),
    "$ne": lambda c, v, kind: c.isNotNull() if v is None else _negate(_equal(c, v, kind)),
    "$in": _is_in,
    "$nin": lambda c, v, kind: _negate(_is_in(c, v, kind)),
    "$exists": lambda c, v, kind: c.isNotNull() if v else c.isNull(),
    "$regex": lambda c, v, kind: c.rlike(v),
    "$mod": lambda c, v, kind: c % v[0] == v[1],
    "$size": lambda c, v, kind: F.size(c) == v,
    "$all": lambda c, v, kind: _holds_all(c, v, kind),
    "$elemMatch": lambda c, v, kind: _has_element(c, v, kind),
}

# The letters of "$options" that regular expressions know as flags.
_FLAGS = "imsx"


def _holds_all(column: Column, values: Any, kind: DataType | None) -> Column:
    """All values are elements; no values are in no array."""
    inner = kind.elementType if isinstance(kind, ArrayType) else None

    def holds(value: Any) -> Column:
        return F.exists(column, lambda e: F.coalesce(_equal(e, value, inner), F.lit(False)))

    return reduce(lambda a, b: a & b, map(holds, values)) if len(values) else F.lit(False)


def _has_element(column: Column, condition: Mapping[str, Any], kind: DataType | None) -> Column:
    """Some element meets the condition: operators on it, or conditions on its fields."""
    inner = kind.elementType if isinstance(kind, ArrayType) else None
    on_itself = all(str(k).startswith("$") and k not in ("$and", "$or", "$nor") for k in condition)
    fields = {f.name: f.dataType for f in inner.fields} if isinstance(inner, StructType) else {}

    def meets(element: Column) -> Column:
        if on_itself:
            return _condition(element, inner, condition, "an element")
        return _all_of(condition, lambda name: (element[name], fields.get(name)))

    return F.exists(column, lambda e: F.coalesce(meets(e), F.lit(False)))


def _condition(column: Column, kind: DataType | None, condition: Any, name: str) -> Column:
    operators = isinstance(condition, Mapping) and any(str(k).startswith("$") for k in condition)
    if not operators:
        return _equal(column, condition, kind)
    parts = []
    for operator, value in condition.items():
        if operator == "$options" and "$regex" in condition:
            continue
        if operator == "$regex" and (flags := condition.get("$options")):
            if set(flags) - set(_FLAGS):
                raise ValueError(f"unknown options {flags!r} on {name!r}, expected some of {_FLAGS}")
            value = f"(?{flags}){value}"
        if operator == "$not":
            parts.append(_negate(_condition(column, kind, value, name)))
        elif operator in _COMPARE:
            parts.append(_COMPARE[operator](column, value, kind))
        else:
            raise ValueError(f"unknown operator {operator!r} on {name!r}")
    return reduce(lambda a, b: a & b, parts)


def _all_of(spec: Mapping[str, Any], field: Callable[[str], tuple[Column, DataType | None]]) -> Column:
    """Conjunction of the conditions, on the columns that ``field`` gives for names."""
    parts = []
    for name, condition in spec.items():
        if name == "$and":
            parts.append(reduce(lambda a, b: a & b, [_all_of(s, field) for s in condition]))
        elif name == "$or":
            parts.append(reduce(lambda a, b: a | b, [_all_of(s, field) for s in condition]))
        elif name == "$nor":
            parts.append(reduce(lambda a, b: a & b, [_negate(_all_of(s, field)) for s in condition]))
        elif name.startswith("$"):
            raise ValueError(f"unknown operator {name!r}")
        else:
            parts.append(_condition(*field(name), condition, name))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def predicate(spec: Mapping[str, Any], schema: StructType | None = None) -> Column:
    """Conjunction of the conditions in ``spec``.

    ``{"a": 1, "b": {"$gt": 2, "$lt": 5}, "$or": [{...}, {...}]}``; the value
    ``None`` stands for a missing field.  With the ``schema`` of the rows,
    dates are compared in the type of their column.  Array columns take
    ``$size``, ``$all`` and ``$elemMatch``, the last with operators on the
    element or conditions on its fields.
    """
    kinds = {f.name: f.dataType for f in schema.fields} if schema is not None else {}
    return _all_of(spec, lambda name: (F.col(name), kinds.get(name)))
