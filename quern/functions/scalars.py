"""Scalar functions by the names that other SQL dialects use, over Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(column: Column, path: str) -> Column:
    """The text at a JSON path ("$.a.b"), as ->> gives; null if absent."""
    return F.get_json_object(column, path)


def json_object(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))


def to_number(column: Column, precision: int = 38, scale: int = 18) -> Column:
    return column.try_cast(f"decimal({precision},{scale})")


def matches(column: Column, pattern: str) -> Column:
    return column.rlike(pattern)


def case(branches: list[tuple[Column, object]], otherwise: object = None) -> Column:
    out = F.when(branches[0][0], branches[0][1])
    for test, value in branches[1:]:
        out = out.when(test, value)
    return out.otherwise(otherwise)
