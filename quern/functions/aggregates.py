"""Aggregates that need more than one of Spark's own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.sources.tables import quote


def array_agg(column: str, keep_nulls: bool = True) -> Column:
    """Values as a sorted array; null over no rows. collect_list drops nulls, so they travel in structs."""
    c = F.col(quote(column))
    if not keep_nulls:
        return F.when(F.count(F.lit(1)) > 0, F.array_sort(F.collect_list(c)))
    rows = F.array_sort(F.collect_list(F.struct(c.isNull().alias("n"), c.alias("v"))))
    return F.when(F.count(F.lit(1)) > 0, F.transform(rows, lambda r: r["v"]))


def string_agg(column: str, sep: str, order: Sequence[str] = ()) -> Column:
    """Values that aren't null, joined in the order of the order columns, then their own; null if there are none."""
    c = F.col(quote(column)).cast("string")
    rows = F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(*(F.col(quote(o)) for o in order), c.alias("__v")))))
    return F.when(F.count(c) > 0, F.array_join(F.transform(rows, lambda r: r["__v"]), sep))


def count_if(condition: str) -> Column:
    return F.count(F.when(F.expr(condition), 1))


def approx_distinct(column: str, error: float = 0.02) -> Column:
    return F.approx_count_distinct(quote(column), error)
