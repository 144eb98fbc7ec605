"""INSERT, SET and upsert parts, and the checks that rows and assignments pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from quern.errors import build_error
from quern.plans.params import BINDABLE, MISSING, Param, lookup
from quern.plans.query import Part, Writer
from quern.sources.tables import Column, Table, quote


class _Default:
    """The column's default, as a value to insert or set."""

    def __repr__(self) -> str:
        return "DEFAULT"


DEFAULT = _Default()


def check_rows(table: Table, rows: Any) -> tuple[list[str], list[Mapping[str, Any]]]:
    """Keys in the table's order, and the rows: at least one, all with the same known keys."""
    table.allow("insert")
    rows = [rows] if isinstance(rows, Mapping) else rows
    if not isinstance(rows, (list, tuple)) or not rows or not all(isinstance(r, Mapping) for r in rows):
        raise build_error("rows to insert are a list of one mapping or more")
    given = set(rows[0])
    if any(set(r) != given for r in rows):
        raise build_error("all rows to insert have the same keys")
    if unknown := sorted(given - set(table.columns)):
        raise build_error(f"table {table.name} has no columns {unknown}")
    for r in rows:
        for k, v in r.items():
            _check_value(table, k, v)
    return [k for k in table.columns if k in given], list(rows)


def check_assignments(table: Table, values: Any) -> dict[str, Any]:
    table.allow("update")
    if not isinstance(values, Mapping) or not values:
        raise build_error("what to set is a mapping of one column or more")
    if unknown := sorted(set(values) - set(table.columns)):
        raise build_error(f"table {table.name} has no columns {unknown}")
    for k, v in values.items():
        _check_value(table, k, v)
    return {k: values[k] for k in table.columns if k in values}


def _check_value(table: Table, key: str, value: Any) -> None:
    if value is DEFAULT:
        return
    if not isinstance(value, (*BINDABLE, list)):
        raise build_error(f"{table.name}.{key} can't hold a {type(value).__name__}")
    table.check_enums(key, value)


def _write(w: Writer, value: Any) -> str:
    if isinstance(value, list):
        return f"array({w.bind(value)})"
    return "DEFAULT" if value is DEFAULT else w.bind(value)


@dataclass(frozen=True, eq=False)
class InsertPart(Part):
    """Of the rows in a parameter: the column list, the values, or both."""

    table: Table
    param: str = "rows"
    what: str = "both"
    kind = "insert"

    def params(self) -> list[Param]:
        return [Param(self.param)]

    def write(self, w: Writer) -> str:
        keys, rows = check_rows(self.table, lookup(w.values, self.param))
        columns = "(" + ", ".join(quote(self.table.columns[k].name) for k in keys) + ")"
        if self.what == "columns":
            return columns
        values = ", ".join("(" + ", ".join(_write(w, r[k]) for k in keys) + ")" for r in rows)
        return values if self.what == "values" else f"{columns} VALUES {values}"


def insert(table: Table, param: str = "rows") -> InsertPart:
    return InsertPart(table, param)


def insert_columns(table: Table, param: str = "rows") -> InsertPart:
    return InsertPart(table, param, "columns")


def insert_values(table: Table, param: str = "rows") -> InsertPart:
    return InsertPart(table, param, "values")


@dataclass(frozen=True, eq=False)
class SetPart(Part):
    table: Table
    param: str = "set"
    kind = "set"

    def params(self) -> list[Param]:
        return [Param(self.param)]

    def write(self, w: Writer) -> str:
        found = lookup(w.values, self.param)
        values = check_assignments(self.table, None if found is MISSING else found)
        return ", ".join(f"{quote(self.table.columns[k].name)} = {_write(w, v)}" for k, v in values.items())


def set_values(table: Table, param: str = "set") -> SetPart:
    return SetPart(table, param)


@dataclass(frozen=True, eq=False)
class Excluded(Part):
    """The row that an upsert would have inserted."""

    column: Column
    kind = "excluded"

    def write(self, w: Writer) -> str:
        return f"source.{quote(self.column.info.name)}"


def excluded(column: Column) -> Excluded:
    return Excluded(column)


@dataclass(frozen=True, eq=False)
class UpsertPart(Part):
    """MERGE of the rows in a parameter on keys: supplied columns that aren't keys are updated; if there are none, nothing is."""

    table: Table
    keys: tuple[str, ...]
    param: str = "rows"
    kind = "upsert"

    def params(self) -> list[Param]:
        return [Param(self.param)]

    def write(self, w: Writer) -> str:
        given, rows = check_rows(self.table, lookup(w.values, self.param))
        if missing := [k for k in self.keys if k not in given]:
            raise build_error(f"rows to upsert lack the keys {missing}")
        name = {k: quote(self.table.columns[k].name) for k in given}
        view = quote(w.db.view(self.table.name) if w.db else self.table.name)
        values = ", ".join("(" + ", ".join(_write(w, r[k]) for k in given) + ")" for r in rows)
        on = " AND ".join(f"target.{name[k]} = source.{name[k]}" for k in self.keys)
        update = ", ".join(f"target.{name[k]} = source.{name[k]}" for k in given if k not in self.keys)
        matched = f" WHEN MATCHED THEN UPDATE SET {update}" if update else ""
        columns = ", ".join(name.values())
        return f"MERGE INTO {view} AS target USING (VALUES {values}) AS source({columns}) ON {on}{matched} WHEN NOT MATCHED THEN INSERT ({columns}) VALUES ({', '.join(f'source.{n}' for n in name.values())})"


def upsert(table: Table, keys: Sequence[str], param: str = "rows") -> UpsertPart:
    for k in keys:
        table.column(k)
    if not keys:
        raise build_error("an upsert needs keys")
    return UpsertPart(table, tuple(keys), param)
