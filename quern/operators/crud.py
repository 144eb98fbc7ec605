"""Selects over one table, built of the dynamic operators on DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from quern.errors import build_error
from quern.operators.filters import FilterBy, parse_filter, to_column
from quern.operators.includes import include_many, include_one
from quern.operators.ordering import OrderBy, Paginate, parse_order, sort_column
from quern.operators.projection import ProjectBy, parse_projection, project
from quern.plans.params import Param
from quern.sources.tables import Database, Table, quote


@dataclass(frozen=True)
class Include:
    """Child rows under a key: on maps child keys to parent keys; where, order and includes are the child's."""

    child: Table
    on: Mapping[str, str]
    columns: tuple[str, ...] | None = None
    where: Any = None
    order: tuple = ()
    include_many: Mapping[str, Include] = field(default_factory=dict)
    include_one: Mapping[str, Include] = field(default_factory=dict)

    def frame(self, db: Database) -> DataFrame:
        df = _included(db, db.keyed(self.child), self.include_many, self.include_one)
        return df if self.where is None else df.where(_condition(self.child, self.where))

    def shown(self, df: DataFrame) -> list[str]:
        return [*(self.columns or self.child.columns), *self.include_one, *self.include_many]


def _condition(table: Table, where: Any) -> SparkColumn:
    if isinstance(where, (SparkColumn, str)):
        return F.expr(where) if isinstance(where, str) else where
    parsed = parse_filter(table, where)
    return F.lit(True) if parsed is None else to_column(parsed)


def _included(db: Database, df: DataFrame, many: Mapping[str, Include], one: Mapping[str, Include], page: DataFrame | None = None) -> DataFrame:
    """df with its includes; children are limited to those of page, if given, before they are gathered."""
    for includes, add in ((one, include_one), (many, include_many)):
        for key, i in includes.items():
            child = i.frame(db)
            if page is not None:
                names = {c: f"__page{n}" for n, c in enumerate(i.on)}
                parents = page.select(*(F.col(quote(p)).alias(names[c]) for c, p in i.on.items())).distinct()
                child = child.join(parents, F.expr(" AND ".join(f"{quote(c)} = {n}" for c, n in names.items())), "left_semi")
            df = add(df, child, key, i.on, i.shown(child), i.order)
    return df


def _aggregates(chosen: Any) -> bool:
    return bool(chosen) and any(not isinstance(e, str) for e in chosen)


def _plain(table: Table, chosen: Any) -> list[str]:
    """The names that a projection without aggregates selects; unknown ones are errors."""
    return [key for _, key, _ in parse_projection(table, chosen)]


@dataclass(frozen=True)
class Select:
    """where and having are SQL text over keys, Spark columns or filters; the run-time parameters are filter_by, select, order_by, limit and offset.

    A static order counts before a run-time one. A static limit or offset needs an order, as pages of unordered rows mean nothing.
    With includes, the page is taken first, and only its children are gathered; rows that the order leaves equal
    follow their other columns there. Includes stay beside selected columns, and go where aggregates are selected.
    """

    table: Table
    where: Any = None
    select: tuple = ()
    group_by: tuple[str, ...] = ()
    having: str | None = None
    order_by: Mapping[str, str] | None = None
    limit: int | None = None
    offset: int | None = None
    join: tuple[tuple[Table, Mapping[str, str], str], ...] = ()
    include_many: Mapping[str, Include] = field(default_factory=dict)
    include_one: Mapping[str, Include] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.table.allow("select")
        if (self.limit is not None or self.offset is not None) and not self.order_by:
            raise build_error("a static limit or offset needs an order")

    def parameters(self) -> list[Param]:
        return [Param(n) for n in ("filter_by", "select", "order_by", "limit", "offset")]

    def _with_includes(self, db: Database, df: DataFrame, values: Mapping[str, Any], keys: list[str]) -> DataFrame:
        order = parse_order(self.table, self.order_by or values.get("order_by"))
        sorted_by = [sort_column(k, d) for k, d in order]
        page = None
        if any(x is not None for x in (self.limit, self.offset, values.get("limit"), values.get("offset"))):
            # a total order, as the page is read for its rows and for its children
            rest = [F.col(quote(c)) for c in df.columns if c not in dict(order) and not isinstance(df.schema[c].dataType, MapType)]
            df = df.orderBy(*sorted_by, *rest)
            df = df if self.offset is None else df.offset(self.offset)
            df = df if self.limit is None else df.limit(self.limit)
            page = df = Paginate().apply(df, values)
        df = _included(db, df, self.include_many, self.include_one, page)
        df = df.orderBy(*sorted_by) if sorted_by else df
        chosen = values.get("select") or self.select
        return df.select(*(quote(c) for c in dict.fromkeys([*_plain(self.table, chosen), *keys]))) if chosen else df

    def dataframe(self, db: Database, params: Mapping[str, Any] | None = None, context: Mapping[str, Any] | None = None) -> DataFrame:
        values = params or {}
        df = db.keyed(self.table)
        for other, on, how in self.join:
            right = db.keyed(other)
            condition = None
            for mine, theirs in on.items():
                same = df[quote(mine)] == right[quote(theirs)]
                condition = same if condition is None else condition & same
            joined = df.join(right, condition, how)
            clash = set(df.columns)
            df = joined.select(*(df[quote(c)] for c in df.columns), *(right[quote(c)] for c in right.columns if c not in clash)) if how not in ("left_semi", "left_anti") else joined
        if self.where is not None:
            df = df.where(_condition(self.table, self.where))
        df = FilterBy(self.table).apply(df, values)
        keys = [*self.include_one, *self.include_many]
        if keys and not _aggregates(values.get("select") or self.select) and not self.group_by and not self.having:
            return self._with_includes(db, df, values, keys)
        df = _included(db, df, self.include_many, self.include_one)
        order = parse_order(self.table, self.order_by) if self.order_by else None
        projected = "select" in values and values["select"] or self.select or self.group_by
        aggregated = projected and _aggregates(values.get("select") or self.select)
        if order and not aggregated:
            df = df.orderBy(*(sort_column(k, d) for k, d in order))
        elif not order and not aggregated and not keys:
            df = OrderBy(self.table).apply(df, values)
        if self.select and not values.get("select"):
            df = project(df, parse_projection(self.table, self.select))
        elif not keys:
            df = ProjectBy(self.table).apply(df, values) if not self.join or values.get("select") else df
        if self.having:
            df = df.where(self.having)
        if aggregated and (order or values.get("order_by")):
            order = order or parse_order(self.table, values["order_by"])
            df = df.orderBy(*(sort_column(k, d) for k, d in order))
        df = df if self.offset is None else df.offset(self.offset)
        df = df if self.limit is None else df.limit(self.limit)
        return Paginate().apply(df, values)


def select(table: Table, **more: Any) -> Select:
    return Select(table, **{k: tuple(v) if isinstance(v, (list, Sequence)) and not isinstance(v, str) else v for k, v in more.items()})
