"""Nested includes: the child rows of each parent row as an array of structs, or one of them as a struct."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.errors import build_error
from quern.operators.ordering import sort_column
from quern.plans.query import Part, Query, Writer
from quern.sources.tables import quote

Order = Sequence[tuple[str, bool]]


def ordered_array(payload: Sequence[str], order: Order, name: str) -> F.Column:
    """Aggregate: an array of structs of the payload columns, sorted by (column, descending) pairs, then by the payload.

    collect_list has no order of its own after a shuffle. Descending keys are sorted by a comparator; nulls are greatest.
    """
    fields = F.struct(*(F.col(quote(c)) for c in payload))
    keys = F.struct(*(F.col(quote(c)).alias(f"k{i}") for i, (c, _) in enumerate(order)))
    rows = F.collect_list(F.struct(keys.alias("k"), fields.alias("v")) if order else F.struct(fields.alias("v")))

    def compare(a: F.Column, b: F.Column) -> F.Column:
        out = F.when(a["v"] < b["v"], -1).when(a["v"] > b["v"], 1).otherwise(0)
        for i, (_, descending) in reversed(list(enumerate(order))):
            x, y = a["k"][f"k{i}"], b["k"][f"k{i}"]
            sign = -1 if descending else 1
            out = F.when(x.isNull() & y.isNotNull(), sign).when(x.isNotNull() & y.isNull(), -sign).when(x < y, -sign).when(x > y, sign).otherwise(out)
        return out

    return F.transform(F.array_sort(rows, compare), lambda r: r["v"]).alias(name)


def include_many(parent: DataFrame, child: DataFrame, key: str, on: Mapping[str, str], columns: Sequence[str] | None = None, order: Order = ()) -> DataFrame:
    """parent with a column key: an array of the child rows whose on-columns equal the parent's; [] where there are none.

    on maps child columns to parent columns. Children are aggregated by their foreign key first, so that the join meets one
    row a parent and the parent isn't multiplied; the array holds the rows of one parent only.
    """
    columns = list(columns or child.columns)
    grouped = child.where(" AND ".join(f"{quote(c)} IS NOT NULL" for c in on)).groupBy(*(F.col(quote(c)).alias(f"__fk{i}") for i, c in enumerate(on)))
    rows = grouped.agg(ordered_array(columns, order, "__rows"))
    out = _joined(parent, rows, on)
    return out.select(*parent.columns, F.coalesce("__rows", F.array().cast(rows.schema["__rows"].dataType)).alias(key))


def include_one(parent: DataFrame, child: DataFrame, key: str, on: Mapping[str, str], columns: Sequence[str] | None = None, order: Order = ()) -> DataFrame:
    """parent with a column key: the first child row by order as a struct; null where there is none.

    Of rows that order leaves equal, the least by its columns counts, so that results repeat. The
    first row is a minimum, computed before the shuffle too, wherever all keys ascend.
    """
    columns = list(columns or child.columns)
    child = child.where(" AND ".join(f"{quote(c)} IS NOT NULL" for c in on))
    fields = F.struct(*(F.col(quote(c)) for c in columns)).alias("__row")
    fks = [F.col(quote(c)).alias(f"__fk{i}") for i, c in enumerate(on)]
    if not any(d for _, d in order):
        keys = [F.struct(F.col(quote(c)).isNull().alias("n"), F.col(quote(c)).alias("v")).alias(f"k{i}") for i, (c, _) in enumerate(order)]
        rows = child.select(*fks, F.struct(*keys, fields).alias("__all")).groupBy(*(f"__fk{i}" for i in range(len(on)))).agg(F.min("__all.__row" if not order else "__all").alias("__least"))
        rows = rows.withColumn("__row", F.col("__least.__row") if order else F.col("__least")).drop("__least")
    else:
        w = Window.partitionBy(*(quote(c) for c in on)).orderBy(*(sort_column(c, d) for c, d in order), *(F.col(quote(c)) for c in columns))
        rows = child.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*fks, fields)
    return _joined(parent, rows, on).select(*parent.columns, F.col("__row").alias(key))


def _joined(parent: DataFrame, rows: DataFrame, on: Mapping[str, str]) -> DataFrame:
    condition = None
    for i, p in enumerate(on.values()):
        same = parent[quote(p)] == rows[f"__fk{i}"]
        condition = same if condition is None else condition & same
    if condition is None:
        raise build_error("an include needs at least one pair of columns")
    return parent.join(rows, condition, "left")


@dataclass(frozen=True, eq=False)
class JsonMany(Part):
    """In a select list: the correlated rows of a query as an array of structs, [] if there are none; or the first, or null.

    columns are the query's; order are (column, descending) pairs of them, and rows that these leave equal follow by all
    columns, so that results repeat. Catalyst turns the subquery into an outer join.
    """

    of_query: Query
    columns: tuple[str, ...]
    label: str | None = None
    order: tuple = ()
    one: bool = False
    kind = "include"

    @property
    def name(self) -> str | None:
        return self.label

    def as_(self, key: str) -> JsonMany:
        return replace(self, label=key)

    def write(self, w: Writer) -> str:
        if w.clause != "select":
            raise build_error("an include stands in a select list only")
        w.clause = "start"
        inner = w.query(self.of_query, "inner")
        w.clause = "select"
        name = quote(w.name_of(self.of_query))
        fields = ", ".join(f"'{c}', {name}.{quote(c)}" for c in self.columns)
        rows = f"collect_list(named_struct({fields}))"
        if self.order:
            steps = "".join(f" WHEN l.{quote(c)} IS NULL AND r.{quote(c)} IS NOT NULL THEN {-s} WHEN l.{quote(c)} IS NOT NULL AND r.{quote(c)} IS NULL THEN {s} WHEN l.{quote(c)} < r.{quote(c)} THEN {s} WHEN l.{quote(c)} > r.{quote(c)} THEN {-s}" for c, d in self.order for s in ((1,) if d else (-1,)))
            rows = f"array_sort({rows}, (l, r) -> CASE{steps} WHEN l < r THEN -1 WHEN l > r THEN 1 ELSE 0 END)"
        else:
            rows = f"array_sort({rows})"
        value = f"get({rows}, 0)" if self.one else rows
        text = f"(SELECT {value} FROM {inner} AS {name})"
        # the aggregate of no rows is an empty array, but decorrelation gives null where the join finds none
        text = text if self.one else f"coalesce({text}, array())"
        return f"{text} AS {quote(self.label)}" if self.label else text


def json_many(q: Query, columns: Sequence[str] | None = None, order: Order = ()) -> JsonMany:
    columns = columns or q.columns
    if not columns:
        raise build_error("an include needs its query's columns; give the query a row()")
    return JsonMany(q, tuple(columns), order=tuple(order))


def json_one(q: Query, columns: Sequence[str] | None = None, order: Order = ()) -> JsonMany:
    return replace(json_many(q, columns, order), one=True)
