"""Queries as values: SQL templates whose parts are tables, columns, other queries, parameters and operators.

    sql("select {row} from {o} where {o_status} = {status}", row=row(...), o=Order, o_status=Order.c.status, status=param("status"))

A template becomes Spark SQL text with named arguments; values never enter the text. What a part becomes depends on the
clause it stands in, which the writer follows through the template's keywords and parentheses.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame

from quern.errors import build_error
from quern.plans.params import BINDABLE, CONTEXT_VALUE, Param
from quern.sources.tables import IDENTIFIER, AllColumns, Column, Database, Table, quote

_HOLE = re.compile(r"\{\{|\}\}|\{(\w+)\}")
_TOKENS = re.compile(r"('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/)|(\w+)|(\()|(\))|(\?)|(::)|(:\w+)", re.S)
_BEFORE_ENTRY, _AFTER_ENTRY = re.compile(r"(?:\bselect|\bdistinct|,)\s*$", re.I), re.compile(r"\s*(?:,|$|\)|from\b)", re.I)
#: Keywords that start a clause.
CLAUSES = {"with": "with", "select": "select", "from": "from", "join": "from", "where": "where", "on": "where", "having": "where", "group": "group", "order": "order", "partition": "order", "limit": "limit", "offset": "limit", "union": "start", "intersect": "start", "except": "start", "values": "values", "set": "set", "into": "into", "update": "into"}
_OPENS_QUERY = {"from", "join", "in", "exists", "lateral", "as", "any", "all", "union", "except", "intersect"}


class Part:
    """Anything that writes itself into a query; subclass it for operators of your own."""

    kind = ""

    def write(self, w: Writer) -> str:
        raise NotImplementedError

    def params(self) -> Iterable[Param]:
        return ()


class Writer:
    """State while a query tree becomes text: arguments, aliases by scope, clause, names given to CTEs."""

    def __init__(self, db: Database | None = None, params: Mapping[str, Any] | None = None, context: Mapping[str, Any] | None = None):
        self.db, self.values, self.context = db, params or {}, context or {}
        self.args: dict[str, Any] = {}
        self.scopes: list[dict[tuple[str, str | None], str]] = []
        self.clause, self.stack = "start", []
        self.named: dict[int, str] = {}
        self.ctes: set[int] = set()
        self.last_word, self.taken, self.bare = "", 0, False
        self.item: list[Any] = []

    def bind(self, value: Any) -> str:
        """A placeholder for a value; lists expand, and an empty one is NULL, which is in nothing."""
        if value is CONTEXT_VALUE:
            value = None
        if isinstance(value, (list, tuple)):
            return ", ".join(self.bind(v) for v in value) or "NULL"
        if not isinstance(value, BINDABLE):
            raise build_error(f"a {type(value).__name__} can't be bound")
        name = f"p{len(self.args)}"
        self.args[name] = value
        return f":{name}"

    def resolve(self, p: Param) -> Any:
        return p.resolve(self.values, self.context)

    def alias(self, table: Table) -> str:
        key = (table.name, table.alias)
        scope = self.scopes[-1]
        if key not in scope:
            self.taken += table.alias is None
            scope[key] = table.alias or f"{table.name[:1]}_{self.taken}"
        return scope[key]

    def outer_alias(self, table: Table) -> str:
        for scope in reversed(self.scopes[:-1]):
            if (table.name, table.alias) in scope:
                return scope[table.name, table.alias]
        raise build_error(f"no enclosing query has {table.alias or table.name}")

    def name_of(self, q: Query) -> str:
        if id(q) not in self.named:
            self.named[id(q)] = q.label or f"query_{len(self.named) + 1}"
        return self.named[id(q)]

    def literal(self, text: str) -> str:
        """Template text: follows its keywords and parentheses, and refuses placeholders of its own."""
        for m in _TOKENS.finditer(text):
            _, word, opening, closing, mark, _, named = m.groups()
            if mark or named:
                raise build_error(f"the template has a raw placeholder {mark or named!r}")
            if word:
                low = word.lower()
                self.clause = CLAUSES.get(low, self.clause)
                self.last_word = low
            elif opening:
                self.stack.append(self.clause)
                function = text[: m.start()][-1:].isalnum() or text[: m.start()][-1:] == "_"
                self.clause = "start" if self.last_word in _OPENS_QUERY else "function" if function and self.last_word not in CLAUSES else self.clause
                self.last_word = "("
            elif closing and self.stack:
                self.clause, self.last_word = self.stack.pop(), ")"
        return text

    def part(self, x: Any) -> str:
        if isinstance(x, Part):
            return x.write(self)
        if isinstance(x, Column):
            return self.column(x)
        if isinstance(x, AllColumns):
            if self.clause == "function" or self.last_word == "exists":
                return "*"
            return ", ".join(self.column(x.table.column(k)) for k in x.table.columns) if self.clause == "select" else "*"
        if isinstance(x, Table):
            view = quote(self.db.view(x.name) if self.db else x.name)
            if self.clause == "into":
                return view
            alias = quote(self.alias(x))
            return f"{view} AS {alias}" if self.clause in ("from", "start", "with") else alias
        if isinstance(x, Param):
            return self.bind(self.resolve(x))
        if isinstance(x, (list, tuple)):
            return ", ".join(self.part(v) for v in x) or "NULL"
        return self.bind(x)

    def column(self, c: Column, named: bool | None = None) -> str:
        alias = self.outer_alias(c.table) if c.outer else self.alias(c.table)
        text = f"{quote(alias)}.{quote(c.info.name)}"
        return f"{text} AS {quote(c.name)}" if (self.clause == "select" if named is None else named) else text

    def entry(self, c: Any) -> str:
        clause = self.clause
        if clause == "select" and self.bare:
            self.clause = "where"
        text = self.part(c)
        self.clause = clause
        return text

    def query(self, q: Query, form: str | None = None) -> str:
        if form == "inline":
            return q.body(self)
        name = quote(self.name_of(q))
        form = form or {"with": "with", "from": "from", "start": "inner"}.get(self.clause, "inner")
        if form == "from" and id(q) in self.ctes or form == "name":
            return name
        if form == "with":
            self.ctes.add(id(q))
        clause, last, stack = self.clause, self.last_word, self.stack
        self.scopes.append({})
        self.clause, self.last_word, self.stack = "start", "", []
        text = q.body(self)
        self.scopes.pop()
        self.clause, self.last_word, self.stack = clause, last, stack
        return {"with": f"{name} AS ({text})", "from": f"({text}) AS {name}", "inner": f"({text})"}[form]


@dataclass(frozen=True, eq=False)
class Query(Part):
    """An immutable query. Nothing runs until a DataFrame of it is acted on."""

    template: str
    parts: Mapping[str, Any]
    label: str | None = None
    tags: tuple[str, ...] = ()
    columns: tuple[str, ...] | None = None

    kind = "query"

    # -- composition

    def named(self, label: str) -> Query:
        if not IDENTIFIER.match(label):
            raise build_error(f"{label!r} is no name for a query")
        return replace(self, label=label)

    def authorize(self, *tags: str) -> Query:
        return replace(self, tags=tuple(dict.fromkeys((*self.tags, *tags))))

    @property
    def all_tags(self) -> tuple[str, ...]:
        """Own tags and those of the queries in it."""
        return tuple(dict.fromkeys((*self.tags, *(t for q in self.inner() for t in q.all_tags))))

    @property
    def c(self) -> _QueryKeys:
        return _QueryKeys(self)

    @property
    def all(self) -> Part:
        return QueryAll(self)

    @property
    def out(self) -> Part:
        """The query by name only, as a recursive CTE needs itself."""
        return QueryAs(self, "name")

    def inline(self) -> Part:
        return QueryAs(self, "inline")

    def render(self, form: str) -> Part:
        return QueryAs(self, form)

    # -- what is in it

    def _values(self) -> Iterable[Any]:
        def walk(x: Any) -> Iterable[Any]:
            yield x
            if isinstance(x, (list, tuple)):
                for v in x:
                    yield from walk(v)
            elif isinstance(x, Mapping):
                for v in x.values():
                    yield from walk(v)
            elif isinstance(x, Part) and not isinstance(x, Query):
                for k, v in vars(x).items():
                    if k != "of":
                        yield from walk(v)
                if isinstance(x, QueryAs) and x.form in ("inline", "with", "from", "inner"):
                    yield x.of

        for v in self.parts.values():
            yield from walk(v)

    def inner(self) -> list[Query]:
        return [v for v in self._values() if isinstance(v, Query) and v is not self]

    def parameters(self) -> list[Param]:
        """All parameters, of inner queries too, in order and once."""
        own = [p for v in self._values() for p in ([v] if isinstance(v, Param) else list(v.params()) if isinstance(v, Part) and not isinstance(v, Query) else [])]
        return list(dict.fromkeys([*own, *(p for q in self.inner() for p in q.parameters())]))

    @property
    def hash(self) -> str:
        """SHA-256 over templates, inner hashes and names of parameters: the same query text gives the same hash anywhere."""
        names = sorted(("context:" if p.context else "") + p.name for p in self.parameters())
        shape = [f"{k}={_shape(v)}" for k, v in sorted(self.parts.items())]
        return hashlib.sha256(json.dumps([self.template, shape, [q.hash for q in self.inner()], names]).encode()).hexdigest()

    # -- text and execution

    def body(self, w: Writer) -> str:
        out, end = [], 0
        for m in _HOLE.finditer(self.template):
            out.append(w.literal(self.template[end : m.start()]))
            end = m.end()
            # a column that is a whole entry of a select list gets its name; one inside an expression doesn't
            w.bare = not (_BEFORE_ENTRY.search(self.template[: m.start()]) and _AFTER_ENTRY.match(self.template[end:]))
            if m[1] is None:
                out.append(w.literal(m[0][0]))
            elif m[1] not in self.parts:
                raise build_error(f"the template names {m[1]!r}, which isn't given")
            else:
                out.append(w.part(self.parts[m[1]]) if not isinstance(self.parts[m[1]], (Column, QueryColumn)) else w.entry(self.parts[m[1]]))
        out.append(w.literal(self.template[end:]))
        return "".join(out)

    def write(self, w: Writer) -> str:
        return w.query(self)

    def to_sql(self, db: Database | None = None, params: Mapping[str, Any] | None = None, context: Mapping[str, Any] | None = None) -> tuple[str, dict[str, Any]]:
        """Text and named arguments, without running anything."""
        w = Writer(db, params, context)
        w.scopes.append({})
        text = self.body(w)
        note = f"/* {self.label} */ " if self.label else ""
        return note + text, w.args

    def dataframe(self, db: Database, params: Mapping[str, Any] | None = None, context: Mapping[str, Any] | None = None) -> DataFrame:
        text, args = self.to_sql(db, params, context)
        return db.spark.sql(text, args=args)


def _shape(x: Any) -> str:
    if isinstance(x, Query):
        return "query"
    if isinstance(x, Param):
        return "param"
    if isinstance(x, Column):
        return f"{x.table.name}.{x.key}{'^' if x.outer else ''}:{x.name}"
    if isinstance(x, (Table, AllColumns)):
        t = x if isinstance(x, Table) else x.table
        return f"{t.name}:{t.alias}{'*' if isinstance(x, AllColumns) else ''}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(_shape, x)) + "]"
    if isinstance(x, Mapping):
        return "{" + ",".join(f"{k}:{_shape(v)}" for k, v in x.items()) + "}"
    if isinstance(x, Part):
        return type(x).__name__ + _shape({k: v for k, v in vars(x).items() if k != "of"})
    return repr(x)


class _QueryKeys:
    def __init__(self, q: Query):
        self._query = q

    def __getattr__(self, key: str) -> QueryColumn:
        if self._query.columns is not None and key not in self._query.columns:
            raise build_error(f"the query has no column {key!r}")
        return QueryColumn(self._query, key)

    __getitem__ = __getattr__


@dataclass(frozen=True, eq=False)
class QueryColumn(Part):
    of: Query
    key: str
    label: str | None = None
    kind = "queryColumn"

    @property
    def name(self) -> str:
        return self.label or self.key

    def as_(self, key: str) -> QueryColumn:
        return replace(self, label=key)

    def write(self, w: Writer) -> str:
        text = f"{quote(w.name_of(self.of))}.{quote(self.key)}"
        return f"{text} AS {quote(self.name)}" if w.clause == "select" else text


@dataclass(frozen=True, eq=False)
class QueryAll(Part):
    of: Query
    kind = "queryAll"

    def write(self, w: Writer) -> str:
        return "*" if w.clause == "function" else f"{quote(w.name_of(self.of))}.*"


@dataclass(frozen=True, eq=False)
class QueryAs(Part):
    """A query in a given form: name, inline, with, from or inner."""

    of: Query
    form: str
    kind = "queryAs"

    def write(self, w: Writer) -> str:
        if self.form not in ("name", "inline", "with", "from", "inner"):
            raise build_error(f"no form {self.form!r}")
        return w.query(self.of, self.form)


def sql(template: str, **parts: Any) -> Query:
    columns = next((p.keys() for p in parts.values() if isinstance(p, Part) and callable(getattr(p, "keys", None))), None)
    return Query(template, parts, columns=tuple(columns) if columns else None)


class Recursive:
    """A recursive CTE: WITH RECURSIVE name AS (anchor UNION ALL step), where the step reads from its own name.

    step gets the name as a part. Spark stops at spark.sql.cteRecursionLevelLimit levels; operators.recursion has a loop beyond it.
    """

    def __init__(self, name: str, anchor: Query, step: Any):
        self.query = Query("", {}, label=name)
        rest = step(QueryAs(self.query, "name"))
        object.__setattr__(self.query, "template", "{anchor} UNION ALL {rest}")
        object.__setattr__(self.query, "parts", {"anchor": QueryAs(anchor, "inline"), "rest": QueryAs(rest, "inline")})
