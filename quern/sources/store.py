"""Tables that can change: immutable Parquet files under a versioned manifest, rewritten file by file.

A version is a JSON file that lists each table's data files. A change writes new files beside the old, then a new version by
an atomic rename; readers see whole versions only. Updates, deletes and upserts find the files that hold affected rows and
rewrite these alone, so the cost follows what changes and not the table. One writer at a time: a commit on a version
that isn't the newest any more fails with CONFLICT. There are no isolation levels beyond these snapshots.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import ErrorCode, QueryError, build_error
from quern.operators.mutations import DEFAULT, check_assignments, check_rows
from quern.sources.scratch import written
from quern.sources.tables import Column, Database, Table, quote


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)
        self._fs.mkdirs(self._path(f"{self.root}/_versions"))

    # -- versions

    def version(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/_versions"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def files(self, version: int | None = None) -> dict[str, list[str]]:
        version = self.version() if version is None else version
        if not version:
            return {}
        lines = self.spark.sparkContext.wholeTextFiles(f"{self.root}/_versions/{version}.json").values().collect()
        return json.loads(lines[0])

    def _publish(self, files: Mapping[str, list[str]], base: int) -> int:
        draft = self._path(f"{self.root}/_versions/.{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(files).encode()))
        out.close()
        final = self._path(f"{self.root}/_versions/{base + 1}.json")
        if self.version() != base or self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise QueryError(ErrorCode.CONFLICT, f"another writer has committed since version {base}", retryable=True)
        return base + 1

    # -- reading

    def create(self, table: Table, rows: DataFrame | None = None) -> None:
        """Starts a table, with rows under its physical column names, or empty."""
        with self.transaction() as t:
            if table.name in t.files:
                raise build_error(f"table {table.name!r} exists")
            t.files[table.name] = []
            if rows is not None:
                t.files[table.name] = t._write(table, rows)

    def read(self, table: Table, version: int | None = None) -> DataFrame:
        """Rows under their physical names, of the newest or a given version."""
        return self._frame(table, self.files(version))

    def _frame(self, table: Table, files: Mapping[str, list[str]]) -> DataFrame:
        if table.name not in files:
            raise build_error(f"no table {table.name!r} in this store")
        schema = T.StructType([T.StructField(i.name, i.type, True) for i in table.columns.values()])
        paths = files[table.name]
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{p}" for p in paths)) if paths else self.spark.createDataFrame([], schema)

    def database(self, tables: Sequence[Table]) -> Database:
        return Database(self.spark, {t.name: self.read(t) for t in tables})

    @contextmanager
    def transaction(self, read_only: bool = False):
        """Changes to several tables that become visible together, or not at all if the block raises."""
        base = self.version()
        t = Transaction(self, self.files(base), read_only)
        before = {k: list(v) for k, v in t.files.items()}
        yield t
        if t.files != before:
            self._publish(t.files, base)

    def __getattr__(self, name: str) -> Any:
        """insert, insert_from, update, delete and upsert, each in a transaction of its own."""
        if name not in ("insert", "insert_from", "update", "delete", "upsert"):
            raise AttributeError(name)

        def run(*args: Any, **more: Any) -> DataFrame:
            with self.transaction() as t:
                return getattr(t, name)(*args, **more)

        return run


class Transaction:
    def __init__(self, store: Store, files: dict[str, list[str]], read_only: bool = False):
        self.store, self.files, self.read_only, self.spark = store, files, read_only, store.spark

    @contextmanager
    def savepoint(self):
        """Changes that are taken back alone if the block raises; the error goes on."""
        before = {k: list(v) for k, v in self.files.items()}
        try:
            yield self
        except BaseException:
            self.files.clear()
            self.files.update(before)
            raise

    def read(self, table: Table) -> DataFrame:
        return self.store._frame(table, self.files)

    def _write(self, table: Table, df: DataFrame) -> list[str]:
        if self.read_only:
            raise build_error("the transaction is read-only")
        folder = f"{table.name}/{uuid.uuid4().hex}"
        df.select(*(F.col(quote(i.name)).cast(i.type).alias(i.name) for i in table.columns.values())).write.parquet(f"{self.store.root}/{folder}")
        status = self.store._fs.listStatus(self.store._path(f"{self.store.root}/{folder}"))
        return sorted(f"{folder}/{s.getPath().getName()}" for s in status if s.getPath().getName().endswith(".parquet"))

    def _default(self, table: Table, key: str) -> SparkColumn:
        info = table.columns[key]
        c = F.expr(info.default_expr) if info.default_expr else F.lit(info.default)
        return c.cast(info.type)

    def _rows(self, table: Table, rows: Any) -> tuple[list[str], DataFrame]:
        """Given keys, and rows by physical names with defaults for what isn't given."""
        keys, rows = check_rows(table, rows)
        schema = T.StructType([T.StructField(f"v{i}", table.columns[k].type) for i, k in enumerate(keys)] + [T.StructField(f"d{i}", T.BooleanType()) for i in range(len(keys))])
        data = [tuple(None if r[k] is DEFAULT else r[k] for k in keys) + tuple(r[k] is DEFAULT for k in keys) for r in rows]
        df = self.spark.createDataFrame(data, schema)
        at = {k: i for i, k in enumerate(keys)}
        columns = [(F.when(F.col(f"d{at[k]}"), self._default(table, k)).otherwise(F.col(f"v{at[k]}")) if k in at else self._default(table, k)).alias(i.name) for k, i in table.columns.items()]
        out = df.select(*columns)
        for k, i in table.columns.items():
            if not i.nullable and k in at and any(r[k] is None for r in rows):
                raise build_error(f"{table.name}.{k} can't be null")
        return keys, out

    def insert(self, table: Table, rows: Any) -> DataFrame:
        """Appends rows; returns them by keys, as written."""
        _, df = self._rows(table, rows)
        df = written(df)  # defaults such as uuid() are drawn once
        self.files[table.name] = self.files[table.name] + self._write(table, df)
        return table.renamed(df)

    def insert_from(self, table: Table, df: DataFrame) -> DataFrame:
        """Appends df's rows, whose columns are keys; absent ones get defaults."""
        table.allow("insert")
        if unknown := sorted(set(df.columns) - set(table.columns)):
            raise build_error(f"table {table.name} has no columns {unknown}")
        out = written(df.select(*((F.col(quote(k)).cast(i.type) if k in df.columns else self._default(table, k)).alias(i.name) for k, i in table.columns.items())))
        self.files[table.name] = self.files[table.name] + self._write(table, out)
        return table.renamed(out)

    def _split(self, table: Table, hit: SparkColumn | None, keys: DataFrame | None = None) -> tuple[list[str], list[str]]:
        """Data files with affected rows, and the others. A null predicate affects nothing."""
        paths = self.files[table.name]
        if not paths:
            return [], []
        df = self.read(table).withColumn("__file", F.col("_metadata.file_path"))
        df = df.where(F.coalesce(hit, F.lit(False))) if hit is not None else df
        if keys is not None:
            df = df.join(keys, keys.columns, "left_semi")
        found = {r[0].rsplit("/", 2)[1] + "/" + r[0].rsplit("/", 1)[1] for r in df.select("__file").distinct().collect()}
        touched = [p for p in paths if p.split("/", 1)[1] in found]
        return touched, [p for p in paths if p not in set(touched)]

    def _rewrite(self, table: Table, touched: list[str], others: list[str], make) -> DataFrame:
        """Replaces touched files by what make returns of their rows and __hit; returns affected rows by physical names."""
        frame = self.store._frame(table, {table.name: touched})
        new, affected = make(frame)
        affected = written(affected)
        self.files[table.name] = others + self._write(table, new)
        return affected

    def update(self, table: Table, values: Any, where: SparkColumn | str | None = None) -> DataFrame:
        """Sets columns of the rows for which where (over physical names) is true, all if it is None; returns them as they are then."""
        values = check_assignments(table, values)
        hit = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False)) if where is not None else F.lit(True)
        touched, others = self._split(table, hit)
        if not touched:
            return table.renamed(self.read(table).limit(0))
        for k, v in values.items():
            if v is None and not table.columns[k].nullable:
                raise build_error(f"{table.name}.{k} can't be null")

        def make(df: DataFrame) -> tuple[DataFrame, DataFrame]:
            marked = df.withColumn("__hit", hit)
            columns = []
            for k, i in table.columns.items():
                own = F.col(quote(i.name))
                if k in values:
                    v = values[k]
                    new = self._default(table, k) if v is DEFAULT else F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
                    own = F.when(F.col("__hit"), new.cast(i.type)).otherwise(own)
                columns.append(own.alias(i.name))
            out = written(marked.select(*columns, "__hit"))
            return out.drop("__hit"), out.where("__hit").drop("__hit")

        return table.renamed(self._rewrite(table, touched, others, make))

    def delete(self, table: Table, where: SparkColumn | str | None = None, force: bool = False) -> DataFrame:
        """Removes the rows for which where is true and returns them; all rows only with force. Where it is null, a row stays."""
        table.allow("delete")
        if where is None and not force:
            raise build_error("deleting all rows needs force")
        hit = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False)) if where is not None else F.lit(True)
        touched, others = self._split(table, hit)
        if not touched:
            return table.renamed(self.read(table).limit(0))
        return table.renamed(self._rewrite(table, touched, others, lambda df: (df.where(~hit), df.where(hit))))

    def upsert(self, table: Table, rows: Any, keys: Sequence[str], update: Mapping[str, Any] | None = None) -> DataFrame:
        """Inserts rows; where one with the same keys exists, its supplied columns that aren't keys are set, or those in update.

        update maps keys to excluded columns (Column of the new row) or SQL text over old and new (aliases). Keys must be unique among
        the rows. Returns the rows as they are then; rows that are left alone, as there is nothing to set, aren't returned.
        """
        given, df = self._rows(table, rows)
        if missing := [k for k in keys if k not in given]:
            raise build_error(f"rows to upsert lack the keys {missing}")
        if len({tuple(r[k] for k in keys) for r in ([rows] if isinstance(rows, Mapping) else rows)}) != df.count():
            raise build_error("rows to upsert repeat a key")
        new = written(df)
        names = [table.columns[k].name for k in keys]
        touched, others = self._split(table, None, new.select(*map(quote, names)))
        old = self.store._frame(table, {table.name: touched}).alias("old")
        both = old.join(F.broadcast(new.alias("new")), [F.col(f"old.{quote(n)}") == F.col(f"new.{quote(n)}") for n in names], "left") if touched else None
        sets = {k: F.col(f"new.{quote(table.columns[k].name)}") for k in given if k not in keys}
        if update is not None:
            sets = {k: F.col(f"new.{quote(v.info.name)}") if isinstance(v, Column) else F.expr(v) for k, v in update.items()}
        fresh = new.join(self.read(table).select(*map(quote, names)), names, "left_anti").select(*(quote(i.name) for i in table.columns.values()))
        fresh = written(fresh)
        affected = fresh
        if both is not None:
            hit = F.col(f"new.{quote(names[0])}").isNotNull()
            merged = written(both.select(*((F.when(hit, sets[k].cast(i.type)).otherwise(F.col(f"old.{quote(i.name)}")) if k in sets else F.col(f"old.{quote(i.name)}")).alias(i.name) for k, i in table.columns.items()), hit.alias("__hit")))
            if sets:
                affected = affected.unionByName(merged.where("__hit").drop("__hit"))
                self.files[table.name] = others + self._write(table, merged.drop("__hit"))
        if not fresh.isEmpty():
            self.files[table.name] = self.files[table.name] + self._write(table, fresh)
        return table.renamed(affected)
