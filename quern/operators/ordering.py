"""Sort orders and pages named at run time."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.errors import build_error
from quern.plans.params import MISSING, Param, lookup
from quern.plans.query import Part, Writer
from quern.sources.tables import Table, quote


def parse_order(table: Table, given: Any) -> list[tuple[str, bool]]:
    """(key, descending) in order of priority; a falsy direction ascends."""
    if given is None or given is MISSING:
        return []
    if not isinstance(given, Mapping):
        raise build_error("an order is a mapping of keys to directions")
    out = []
    for key, direction in given.items():
        if key not in table.columns:
            raise build_error(f"{key!r} is no column to order by")
        word = str(direction).lower() if direction else "asc"
        if word not in ("asc", "desc"):
            raise build_error(f"no direction {direction!r}")
        out.append((key, word == "desc"))
    return out


def sort_column(key: str, descending: bool, nulls: str | None = None) -> SparkColumn:
    """Null values count as the greatest unless nulls says "first" or "last"."""
    c, last = F.col(quote(key)), (nulls or ("first" if descending else "last")) == "last"
    if descending:
        return c.desc_nulls_last() if last else c.desc_nulls_first()
    return c.asc_nulls_last() if last else c.asc_nulls_first()


@dataclass(frozen=True, eq=False)
class OrderBy(Part):
    """ORDER BY of a parameter, {key: "asc" or "desc"}; nothing without it."""

    table: Table
    param: str = "order_by"
    nulls: str | None = None
    keyword: bool = True
    kind = "orderBy"

    def params(self) -> list[Param]:
        return [Param(self.param)]

    def write(self, w: Writer) -> str:
        order = parse_order(self.table, lookup(w.values, self.param))
        texts = [f"{w.column(self.table.column(k), named=False)} {'DESC' if d else 'ASC'} NULLS {(self.nulls or ('first' if d else 'last')).upper()}" for k, d in order]
        return ("ORDER BY " if self.keyword else "") + ", ".join(texts) if texts else ""

    def apply(self, df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
        order = parse_order(self.table, lookup(values, self.param))
        return df.orderBy(*(sort_column(k, d, self.nulls) for k, d in order)) if order else df


def order_by(table: Table, param: str = "order_by", **more: Any) -> OrderBy:
    return OrderBy(table, param, **more)


def _count(values: Mapping[str, Any], name: str) -> int | None:
    n = lookup(values, name)
    if n is MISSING or n is None:
        return None
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise build_error(f"{name} must be a whole number of 0 or more")
    return n


@dataclass(frozen=True, eq=False)
class Paginate(Part):
    """LIMIT and OFFSET of two parameters; either may be absent."""

    limit: str = "limit"
    offset: str = "offset"
    kind = "pagination"

    def params(self) -> list[Param]:
        return [Param(self.limit), Param(self.offset)]

    def write(self, w: Writer) -> str:
        limit, offset = _count(w.values, self.limit), _count(w.values, self.offset)
        out = [] if limit is None else [f"LIMIT {w.bind(limit)}"]
        return " ".join(out + ([] if offset is None else [f"OFFSET {w.bind(offset)}"]))

    def apply(self, df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
        limit, offset = _count(values, self.limit), _count(values, self.offset)
        df = df if offset is None else df.offset(offset)
        return df if limit is None else df.limit(limit)


def paginate(limit: str = "limit", offset: str = "offset") -> Paginate:
    return Paginate(limit, offset)
