"""Branches and repetitions resolved while the query is built."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from quern.errors import build_error
from quern.plans.params import MISSING, Param, lookup
from quern.plans.query import Part, Query, Writer
from quern.sources.tables import Table, quote


def present(value: Any) -> bool:
    """Neither absent nor None nor false; 0 and empty text are present."""
    return not (value is MISSING or value is None or value is False)


def _written(x: Any, w: Writer) -> str:
    return "" if x is None else w.query(x, "inline") if isinstance(x, Query) else w.part(x)


@dataclass(frozen=True, eq=False)
class When(Part):
    """One of two branches, by whether a parameter is present; "!name" turns it round. The other branch leaves no trace."""

    flag: str
    yes: Any
    no: Any = None
    kind = "when"

    def params(self) -> list[Param]:
        return [Param(self.flag.removeprefix("!"))]

    def write(self, w: Writer) -> str:
        on = present(lookup(w.values, self.flag.removeprefix("!"))) != self.flag.startswith("!")
        return _written(self.yes if on else self.no, w)


def when(flag: str, yes: Any, no: Any = None) -> When:
    return When(flag, yes, no)


@dataclass(frozen=True, eq=False)
class _Cursor(Part):
    what: str
    kind = "cursor"

    def write(self, w: Writer) -> str:
        if not w.item:
            raise build_error("a cursor stands outside of its repetition")
        key, value, table = w.item[-1]
        if self.what == "key":
            return w.column(table.column(key), named=False) if table is not None else quote(key)
        return w.bind(value)


def it() -> _Cursor:
    """The element at hand of each()."""
    return _Cursor("value")


each_value = it


def each_key() -> _Cursor:
    """The key at hand of each_object(): a column where a table gates it, else a quoted name."""
    return _Cursor("key")


def _items(name: str, w: Writer, kind: type) -> Any:
    found = lookup(w.values, name)
    if found is MISSING or found is None:
        return kind()
    if not isinstance(found, (Mapping if kind is dict else (list, tuple))):
        raise build_error(f"{name} must be {'an object' if kind is dict else 'a list'}")
    return found


@dataclass(frozen=True, eq=False)
class Each(Part):
    """A template for each element of a list parameter, joined; nothing if it is empty or absent."""

    param: str
    body: Any = None
    sep: str = ", "
    kind = "each"

    def params(self) -> list[Param]:
        return [Param(self.param)]

    def write(self, w: Writer) -> str:
        out = []
        for v in _items(self.param, w, list):
            w.item.append((None, v, None))
            out.append(w.bind(v) if self.body is None else _written(self.body, w))
            w.item.pop()
        return self.sep.join(out)


def each(param: str, body: Any = None, sep: str = ", ") -> Each:
    return Each(param, body, sep)


@dataclass(frozen=True, eq=False)
class EachObject(Part):
    """A template for each entry of an object parameter, joined. With a table, keys that aren't its columns are passed over."""

    param: str
    body: Any
    sep: str = ", "
    table: Table | None = None
    kind = "eachObject"

    def params(self) -> list[Param]:
        return [Param(self.param)]

    def write(self, w: Writer) -> str:
        out = []
        for k, v in _items(self.param, w, dict).items():
            if self.table is not None and k not in self.table.columns:
                continue
            w.item.append((k, v, self.table))
            out.append(_written(self.body, w))
            w.item.pop()
        return self.sep.join(out)


def each_object(param: str, body: Any, sep: str = ", ", table: Table | None = None) -> EachObject:
    return EachObject(param, body, sep, table)
