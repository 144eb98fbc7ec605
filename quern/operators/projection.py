"""Select lists: typed rows, computed values, and projections and aggregates named at run time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.errors import build_error
from quern.plans.params import MISSING, Param, lookup
from quern.plans.query import Part, Query, QueryAll, QueryColumn, Writer
from quern.sources.tables import IDENTIFIER, AllColumns, Column, Table, quote

AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


@dataclass(frozen=True, eq=False)
class Raw(Part):
    """Text that enters the query as it is; never build it from values."""

    text: str
    kind = "raw"

    def write(self, w: Writer) -> str:
        return self.text


def raw(text: str) -> Raw:
    return Raw(text)


def quoted(name: str) -> Raw:
    return Raw(quote(name))


@dataclass(frozen=True, eq=False)
class Named(Part):
    """Declares the name of a raw expression that stands before it."""

    name: str
    kind = "named"

    def write(self, w: Writer) -> str:
        return quote(self.name)


def col(name: str) -> Named:
    return Named(name)


@dataclass(frozen=True, eq=False)
class Value(Part):
    """A computed column or scalar subquery."""

    expression: Query
    label: str | None = None
    kind = "value"

    @property
    def name(self) -> str | None:
        return self.label

    def as_(self, key: str) -> Value:
        return replace(self, label=key)

    def write(self, w: Writer) -> str:
        clause, w.clause = w.clause, "where"
        subquery = self.expression.template.lstrip().lower().startswith(("select", "with"))
        text = w.query(self.expression, "inner" if subquery else "inline")
        w.clause = clause
        return f"{text} AS {quote(self.label)}" if self.label and clause == "select" else text


def val(expression: str | Query, **parts: Any) -> Value:
    return Value(expression if isinstance(expression, Query) else Query(expression, parts))


@dataclass(frozen=True, eq=False)
class Row(Part):
    """A select list; of entries with the same name, the last one counts."""

    entries: tuple
    kind = "row"

    def _by_name(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for e in self.entries:
            if isinstance(e, AllColumns):
                out.update({k: e.table.column(k) for k in e.table.columns})
            elif isinstance(e, QueryAll):
                out.update({k: QueryColumn(e.of, k) for k in e.of.columns} if e.of.columns else {f"*{id(e.of)}": e})
            elif isinstance(e, (Column, QueryColumn, Value, Named)) and e.name:
                out[e.name] = e
            else:
                raise build_error(f"row() takes columns, all columns and named values, not {type(e).__name__}")
        return out

    def keys(self) -> list[str] | None:
        names = list(self._by_name())
        return None if any(n.startswith("*") for n in names) else names

    def write(self, w: Writer) -> str:
        return ", ".join(w.part(e) for e in self._by_name().values())


def row(*entries: Any) -> Row:
    out = Row(entries)
    out._by_name()
    return out


#: An entry of a run-time projection: a key, or an aggregate, key or "*", and its name.
Entry = str | Sequence[str]


def parse_projection(table: Table, entries: Sequence[Entry] | None) -> list[tuple[str | None, str, str]]:
    """(aggregate or None, key, name) of each entry; all columns if there are none."""
    if not entries:
        return [(None, k, k) for k in table.columns]
    out = []
    for e in entries:
        agg, key, name = (None, e, e) if isinstance(e, str) else (*e, None)[:3] if len(e) in (2, 3) else (None, None, None)
        if agg is not None and agg not in AGGREGATES:
            raise build_error(f"no aggregate {agg!r}")
        if key not in table.columns and not (agg == "count" and key == "*"):
            raise build_error(f"table {table.name} has no column {key!r}")
        if agg and not (isinstance(name, str) and IDENTIFIER.match(name)):
            raise build_error("an aggregate needs a name that is an identifier")
        out.append((agg, key, name))
    return out


@dataclass(frozen=True, eq=False)
class ProjectBy(Part):
    """The select list that a parameter names; all columns by default."""

    table: Table
    param: str = "select"
    kind = "projectBy"

    def params(self) -> list[Param]:
        return [Param(self.param)]

    def _entries(self, values: Mapping[str, Any]) -> list[tuple[str | None, str, str]]:
        found = lookup(values, self.param)
        return parse_projection(self.table, None if found is MISSING else found)

    def write(self, w: Writer) -> str:
        out = []
        for agg, key, name in self._entries(w.values):
            inner = "*" if key == "*" else w.column(self.table.column(key), named=False)
            out.append(f"{agg}({inner}) AS {quote(name)}" if agg else f"{inner} AS {quote(name)}")
        return ", ".join(out)

    def apply(self, df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
        return project(df, self._entries(values))


@dataclass(frozen=True, eq=False)
class GroupByProjection(Part):
    """GROUP BY of the plain columns of a run-time projection; nothing unless it has both plain columns and aggregates."""

    of: ProjectBy
    kind = "groupByProjection"

    def write(self, w: Writer) -> str:
        entries = self.of._entries(w.values)
        plain = [w.column(self.of.table.column(k), named=False) for a, k, _ in entries if not a]
        return f" GROUP BY {', '.join(plain)}" if plain and len(plain) < len(entries) else ""


def project_by(table: Table, param: str = "select") -> ProjectBy:
    return ProjectBy(table, param)


def aggregate(agg: str, key: str) -> SparkColumn:
    return AGGREGATES[agg](F.lit(1) if key == "*" else F.col(quote(key)))


def project(df: DataFrame, entries: Sequence[tuple[str | None, str, str]]) -> DataFrame:
    """The projection on a DataFrame whose columns are keys: a select, or groups of the plain columns with aggregates."""
    aggregates = [aggregate(a, k).alias(n) for a, k, n in entries if a]
    plain = [F.col(quote(k)).alias(n) for a, k, n in entries if not a]
    if not aggregates:
        return df.select(*plain)
    out = df.groupBy(*plain).agg(*aggregates) if plain else df.agg(*aggregates)
    return out.select(*(quote(n) for _, _, n in entries))
