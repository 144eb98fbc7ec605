"""Queries as portable JSON, and back. Every part has a node; run-time operators stay operators."""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import types as T

from quern.errors import ErrorCode, QueryError
from quern.operators import control, filters, includes, mutations, ordering, projection
from quern.plans import query as q
from quern.plans.params import CONTEXT_VALUE, Param, Rules
from quern.sources import tables

VERSION = 1
PARTS = {c.kind: c for m in (q, projection, filters, ordering, control, mutations, includes) for c in vars(m).values() if isinstance(c, type) and issubclass(c, q.Part) and c.kind and c is not q.Query}
PLAIN = {"param": Param, "rules": Rules, "column": tables.Column, "allColumns": tables.AllColumns, "columnInfo": tables.ColumnInfo, "foreignKey": tables.ForeignKey}
SCALARS = {"datetime": datetime.datetime, "date": datetime.date}


class _Out:
    def __init__(self) -> None:
        self.tables: dict[str, dict] = {}
        self.queries: dict[int, str] = {}
        self.nodes: dict[str, dict] = {}

    def node(self, x: Any) -> Any:
        if x is None or isinstance(x, (bool, int, float, str)):
            return x
        if x is CONTEXT_VALUE:
            return {"kind": "contextValue"}
        if x is mutations.DEFAULT:
            return {"kind": "default"}
        if isinstance(x, (datetime.datetime, datetime.date)):
            return {"kind": "datetime" if isinstance(x, datetime.datetime) else "date", "value": x.isoformat()}
        if isinstance(x, decimal.Decimal):
            return {"kind": "decimal", "value": str(x)}
        if isinstance(x, bytes):
            return {"kind": "bytes", "value": x.hex()}
        if isinstance(x, T.DataType):
            return {"kind": "type", "value": x.json()}
        if isinstance(x, (list, tuple, frozenset)):
            return {"kind": "list", "tuple": isinstance(x, tuple), "items": [self.node(v) for v in (sorted(x) if isinstance(x, frozenset) else x)]}
        if isinstance(x, Mapping):
            return {"kind": "map", "entries": [[k, self.node(v)] for k, v in x.items()]}
        if isinstance(x, tables.Table):
            name = f"{x.name}:{x.alias or ''}"
            if name not in self.tables:
                self.tables[name] = {}
                self.tables[name] = {f.name: self.node(getattr(x, f.name)) for f in dataclasses.fields(x)}
            return {"kind": "table", "name": name}
        if isinstance(x, q.Query):
            if id(x) not in self.queries:
                name = self.queries[id(x)] = f"q{len(self.queries)}"
                self.nodes[name] = {"template": x.template, "label": x.label, "tags": list(x.tags), "columns": list(x.columns) if x.columns is not None else None, "parts": {k: self.node(v) for k, v in x.parts.items()}}
            return {"kind": "query", "name": self.queries[id(x)]}
        kind = next((k for k, c in (PLAIN | PARTS).items() if type(x) is c), None)
        if kind is None:
            raise QueryError(ErrorCode.MANIFEST_INVALID, f"a {type(x).__name__} has no node")
        return {"kind": kind, "fields": {f.name: self.node(getattr(x, f.name)) for f in dataclasses.fields(x) if f.name != "check"}}


def dumps(queries: Mapping[str, q.Query]) -> str:
    out = _Out()
    roots = {name: {"node": out.node(x)["name"], "hash": x.hash, "params": [("context:" if p.context else "") + p.name for p in x.parameters()]} for name, x in queries.items()}
    return json.dumps({"version": VERSION, "roots": roots, "queries": out.nodes, "tables": out.tables}, ensure_ascii=False)


class _In:
    def __init__(self, raw: dict):
        self.raw, self.tables, self.queries = raw, {}, {}

    def value(self, n: Any) -> Any:
        if not isinstance(n, dict):
            return n
        kind = n["kind"]
        if kind == "contextValue":
            return CONTEXT_VALUE
        if kind == "default":
            return mutations.DEFAULT
        if kind in SCALARS:
            return SCALARS[kind].fromisoformat(n["value"])
        if kind == "decimal":
            return decimal.Decimal(n["value"])
        if kind == "bytes":
            return bytes.fromhex(n["value"])
        if kind == "type":
            return T._parse_datatype_json_string(n["value"])
        if kind == "list":
            items = [self.value(v) for v in n["items"]]
            return tuple(items) if n["tuple"] else items
        if kind == "map":
            return {k: self.value(v) for k, v in n["entries"]}
        if kind == "table":
            if n["name"] not in self.tables:
                fields = {k: self.value(v) for k, v in self.raw["tables"][n["name"]].items()}
                self.tables[n["name"]] = tables.Table(**fields | {"crud": frozenset(fields["crud"])})
            return self.tables[n["name"]]
        if kind == "query":
            return self.query(n["name"])
        found = (PLAIN | PARTS).get(kind)
        if found is None:
            raise QueryError(ErrorCode.MANIFEST_INVALID, f"no node {kind!r}")
        return found(**{k: self.value(v) for k, v in n["fields"].items()})

    def query(self, name: str) -> q.Query:
        if name not in self.queries:
            n = self.raw["queries"][name]
            # recursive queries refer to themselves, so the object comes before its parts
            out = self.queries[name] = q.Query(n["template"], {}, n["label"], tuple(n["tags"]), tuple(n["columns"]) if n["columns"] is not None else None)
            object.__setattr__(out, "parts", {k: self.value(v) for k, v in n["parts"].items()})
        return self.queries[name]


def loads(text: str) -> dict[str, q.Query]:
    """The queries of a manifest; their hashes must be what the manifest says."""
    try:
        raw = json.loads(text)
        if raw["version"] != VERSION:
            raise QueryError(ErrorCode.MANIFEST_INVALID, f"version {raw['version']} instead of {VERSION}")
        reader = _In(raw)
        out = {name: reader.query(r["node"]) for name, r in raw["roots"].items()}
    except (ValueError, KeyError, TypeError) as e:
        raise QueryError(ErrorCode.MANIFEST_INVALID, str(e)) from e
    for name, x in out.items():
        if x.hash != raw["roots"][name]["hash"]:
            raise QueryError(ErrorCode.MANIFEST_INVALID, f"{name} isn't what its hash says")
    return out
