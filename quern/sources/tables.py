"""Declared tables and columns, their introspection, and the database that binds them to DataFrames."""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import build_error

IDENTIFIER = re.compile(r"[A-Za-z_]\w*$")


def quote(name: str) -> str:
    """name as a quoted identifier."""
    return "`" + name.replace("`", "``") + "`"


@dataclasses.dataclass(frozen=True)
class ColumnInfo:
    """name is the physical one; default is a Python value or, if given by expression, SQL text."""

    name: str
    type: T.DataType = T.StringType()
    nullable: bool = True
    default: Any = None
    default_expr: str | None = None
    enum: tuple[str, ...] = ()


@dataclasses.dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    table: str
    references: tuple[str, ...]


@dataclasses.dataclass(frozen=True, eq=False)
class Column:
    """A table's column; key names it in results. outer: of the enclosing query's table."""

    table: Table
    key: str
    outer: bool = False
    label: str | None = None

    @property
    def info(self) -> ColumnInfo:
        return self.table.columns[self.key]

    def as_(self, key: str) -> Column:
        return dataclasses.replace(self, label=key)

    @property
    def name(self) -> str:
        return self.label or self.key


@dataclasses.dataclass(frozen=True, eq=False)
class AllColumns:
    """All columns of a table; a star inside a function or EXISTS."""

    table: Table


class _Keys:
    def __init__(self, table: Table, outer: bool):
        self._table, self._outer = table, outer

    def __getattr__(self, key: str) -> Column:
        return self._table.column(key, self._outer)

    __getitem__ = __getattr__


@dataclasses.dataclass(frozen=True, eq=False)
class Table:
    """A value that describes a table: columns by key, keys, and what may be done with it. Views can only be selected from."""

    name: str
    columns: Mapping[str, ColumnInfo]
    pk: tuple[str, ...] = ()
    fk: tuple[ForeignKey, ...] = ()
    alias: str | None = None
    crud: frozenset[str] = frozenset({"select", "insert", "update", "delete"})

    @property
    def c(self) -> _Keys:
        return _Keys(self, False)

    @property
    def out(self) -> _Keys:
        """Columns of this table in the enclosing query."""
        return _Keys(self, True)

    @property
    def all(self) -> AllColumns:
        return AllColumns(self)

    def column(self, key: str, outer: bool = False) -> Column:
        if key not in self.columns:
            raise build_error(f"table {self.name} has no column {key!r}")
        return Column(self, key, outer)

    def as_(self, alias: str) -> Table:
        if not IDENTIFIER.match(alias):
            raise build_error(f"{alias!r} is no alias")
        return dataclasses.replace(self, alias=alias)

    def allow(self, what: str) -> None:
        if what not in self.crud:
            raise build_error(f"{self.name} allows no {what}")

    def reference_to(self, other: Table) -> ForeignKey | None:
        return next((k for k in self.fk if k.table == other.name), None)

    def renamed(self, df: DataFrame) -> DataFrame:
        """df's physical columns under their keys."""
        return df.select(*(F.col(quote(i.name)).alias(k) for k, i in self.columns.items()))

    def check_enums(self, key: str, value: Any) -> None:
        info = self.columns[key]
        if info.enum and value is not None and value not in info.enum:
            raise build_error(f"{self.name}.{key} allows {', '.join(info.enum)}, not {value!r}")

    def struct_type(self) -> T.StructType:
        return T.StructType([T.StructField(i.name, i.type, i.nullable) for i in self.columns.values()])

    @staticmethod
    def from_struct_type(name: str, schema: T.StructType, keys: Mapping[str, str] | None = None, **more: Any) -> Table:
        """keys maps physical names to keys. Field metadata may hold default and enum."""
        columns = {}
        for f in schema.fields:
            meta = f.metadata or {}
            columns[(keys or {}).get(f.name, f.name)] = ColumnInfo(f.name, f.dataType, f.nullable, meta.get("default"), meta.get("default_expr"), tuple(meta.get("enum", ())))
        return Table(name, columns, **more)

    @staticmethod
    def from_dataframe(name: str, df: DataFrame, **more: Any) -> Table:
        return Table.from_struct_type(name, df.schema, **more)

    @staticmethod
    def from_dataclass(cls: type, name: str | None = None, **more: Any) -> Table:
        """A table of a dataclass's fields; X | None is nullable, and field metadata may hold name, default_expr and enum."""
        import types
        import typing

        known = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), bytes: T.BinaryType(), datetime.date: T.DateType(), datetime.datetime: T.TimestampType(), decimal.Decimal: T.DecimalType(38, 18)}
        columns = {}
        hints = typing.get_type_hints(cls)
        for f in dataclasses.fields(cls):
            kind, nullable = hints[f.name], False
            if isinstance(kind, types.UnionType) or typing.get_origin(kind) is typing.Union:
                parts = [a for a in typing.get_args(kind) if a is not type(None)]
                nullable, kind = len(parts) < len(typing.get_args(kind)), parts[0]
            array = typing.get_origin(kind) is list
            spark_type = known[typing.get_args(kind)[0] if array else kind]
            default = None if f.default is dataclasses.MISSING else f.default
            columns[f.name] = ColumnInfo(f.metadata.get("name", f.name), T.ArrayType(spark_type) if array else spark_type, nullable, default, f.metadata.get("default_expr"), tuple(f.metadata.get("enum", ())))
        return Table(name or cls.__name__.lower(), columns, **more)

    @staticmethod
    def from_catalog(spark: SparkSession, name: str, **more: Any) -> Table:
        """What the session's catalog knows of a table or view; views become select-only."""
        found = spark.catalog.getTable(name)
        if found.tableType in ("VIEW", "TEMPORARY") and "crud" not in more:
            more["crud"] = frozenset({"select"})
        return Table.from_struct_type(name, spark.table(name).schema, **more)


class Database:
    """Tables by name as DataFrames, registered as temporary views for SQL text. Nothing is read before an action."""

    _count = 0

    def __init__(self, spark: SparkSession, sources: Mapping[str, DataFrame | str] | None = None):
        Database._count += 1
        self.spark, self._prefix, self._frames = spark, f"quern{Database._count}", {}
        for name, source in (sources or {}).items():
            self.bind(name, source)

    def bind(self, name: str, source: DataFrame | str) -> DataFrame:
        """source is a DataFrame or the path of a Parquet table."""
        df = self.spark.read.parquet(source) if isinstance(source, str) else source
        df.createOrReplaceTempView(self.view(name))
        self._frames[name] = df
        return df

    def view(self, name: str) -> str:
        return f"{self._prefix}_{re.sub(r'\W', '_', name)}"

    def frame(self, table: Table | str) -> DataFrame:
        name = table if isinstance(table, str) else table.name
        if name not in self._frames:
            raise build_error(f"no table {name!r} in this database")
        return self._frames[name]

    def keyed(self, table: Table) -> DataFrame:
        return table.renamed(self.frame(table))

    @staticmethod
    def of_directory(spark: SparkSession, path: str, names: list[str]) -> Database:
        return Database(spark, {n: f"{path}/{n}.parquet" for n in names})


def typed(column: SparkColumn, info: ColumnInfo) -> SparkColumn:
    return column.cast(info.type)
