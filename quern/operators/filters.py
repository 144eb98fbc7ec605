"""Filters named at run time, as Spark columns and as text."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.errors import build_error
from quern.plans.params import BINDABLE, MISSING, Param, lookup
from quern.plans.query import Part, Writer
from quern.sources.tables import Table, quote

#: Operators with the least and greatest number of their arguments.
ARITY = {"=": (1, 1), "!=": (1, 1), "not": (1, 1), ">": (1, 1), ">=": (1, 1), "<": (1, 1), "<=": (1, 1), "like": (1, 1), "notLike": (1, 1), "between": (0, 2), "in": (0, None), "notIn": (0, None), "isNull": (0, 0), "isNotNull": (0, 0)}
_COMPARE = {"=": operator.eq, "!=": operator.ne, "not": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
_SIGNS = {"!=": "<>", "not": "<>"}


@dataclass(frozen=True)
class Test:
    key: str
    op: str
    args: tuple


@dataclass(frozen=True)
class Group:
    """Tests joined by and, or by or."""

    any: bool
    of: tuple


def parse_filter(table: Table, given: Any, include: Sequence[str] | None = None, omit: Sequence[str] = ()) -> Group | None:
    """The tests of a filter; None if there are none.

    A mapping {key: value or [operator, arguments...]} means all of them; a list of mappings too, in which
    {"or": [...]} groups, and keys of one mapping inside an or are alternatives. A bare value means equality, and None equals nothing.
    """

    def test(key: str, spec: Any) -> Test:
        if key not in table.columns or (include is not None and key not in include) or key in omit:
            raise build_error(f"{key!r} is no column to filter by")
        if not isinstance(spec, (list, tuple)):
            op, args = "=", (spec,)
        elif not spec or spec[0] not in ARITY:
            raise build_error(f"no operator {spec[0] if spec else None!r}")
        else:
            op, args = spec[0], tuple(spec[1:])
        low, high = ARITY[op]
        if len(args) < low or high is not None and len(args) > high or op == "between" and len(args) == 1:
            raise build_error(f"{op} doesn't take {len(args)} arguments")
        if bad := [a for a in args if not isinstance(a, BINDABLE)]:
            raise build_error(f"a {type(bad[0]).__name__} can't be compared with")
        return Test(key, op, args)

    def entries(items: Any, any_of: bool) -> Group | None:
        if isinstance(items, Mapping):
            items = [items]
        if not isinstance(items, (list, tuple)):
            raise build_error("a filter is a mapping or a list of them")
        found: list = []
        for item in items:
            if item is None:
                continue
            if not isinstance(item, Mapping):
                raise build_error("an entry of a filter is a mapping")
            for key, spec in item.items():
                if key == "or" and "or" not in table.columns:
                    if (inner := entries(spec, True)) is not None:
                        found.append(inner)
                else:
                    found.append(test(key, spec))
        return Group(any_of, tuple(found)) if found else None

    return None if given is None or given is MISSING else entries(given, False)


def to_column(node: Group | Test) -> SparkColumn:
    """The filter over columns named by their keys."""
    if isinstance(node, Group):
        return functools.reduce(operator.or_ if node.any else operator.and_, map(to_column, node.of))
    c, op, args = F.col(quote(node.key)), node.op, node.args
    if op in _COMPARE:
        return _COMPARE[op](c, F.lit(args[0]))
    if op in ("like", "notLike"):
        return c.like(args[0]) if op == "like" else ~c.like(args[0])
    if op == "isNull" or op in ("between", "in") and not args:
        return c.isNull()
    if op == "isNotNull" or op == "notIn" and not args:
        return c.isNotNull()
    if op == "between":
        return c.between(F.lit(args[0]), F.lit(args[1]))
    return c.isin(*args) if op == "in" else ~c.isin(*args)


def to_text(node: Group | Test, table: Table, w: Writer) -> str:
    if isinstance(node, Group):
        text = (" OR " if node.any else " AND ").join(to_text(n, table, w) for n in node.of)
        return f"({text})" if node.any else text
    c, op, args = w.column(table.column(node.key), named=False), node.op, node.args
    if op in _COMPARE:
        return f"{c} {_SIGNS.get(op, op)} {w.bind(args[0])}"
    if op in ("like", "notLike"):
        return f"{c} {'NOT ' if op == 'notLike' else ''}LIKE {w.bind(args[0])}"
    if op == "isNull" or op in ("between", "in") and not args:
        return f"{c} IS NULL"
    if op == "isNotNull" or op == "notIn" and not args:
        return f"{c} IS NOT NULL"
    if op == "between":
        return f"{c} BETWEEN {w.bind(args[0])} AND {w.bind(args[1])}"
    return f"{c} {'NOT ' if op == 'notIn' else ''}IN ({w.bind(list(args))})"


@dataclass(frozen=True, eq=False)
class FilterBy(Part):
    """The filter that a parameter gives. prefix and suffix appear only with a filter; without either, none is TRUE."""

    table: Table
    param: str = "filter_by"
    include: tuple[str, ...] | None = None
    omit: tuple[str, ...] = ()
    prefix: str = ""
    suffix: str = ""
    kind = "filterBy"

    def params(self) -> list[Param]:
        return [Param(self.param)]

    def _parsed(self, values: Mapping[str, Any]) -> Group | None:
        return parse_filter(self.table, lookup(values, self.param), self.include, self.omit)

    def write(self, w: Writer) -> str:
        parsed = self._parsed(w.values)
        if parsed is None:
            return "" if self.prefix or self.suffix else "TRUE"
        clause, w.clause = w.clause, "where"
        text = to_text(parsed, self.table, w)
        w.clause = clause
        return " ".join(x for x in (self.prefix, text, self.suffix) if x)

    def apply(self, df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
        parsed = self._parsed(values)
        return df if parsed is None else df.where(to_column(parsed))


def filter_by(table: Table, param: str = "filter_by", **more: Any) -> FilterBy:
    return FilterBy(table, param, **{k: tuple(v) if isinstance(v, list) else v for k, v in more.items()})
