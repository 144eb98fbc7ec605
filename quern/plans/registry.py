"""Queries by hash: a caller names a hash and parameters, never SQL."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from quern.errors import ErrorCode, QueryError
from quern.plans.execution import Run
from quern.plans.params import CONTEXT_VALUE, merge
from quern.plans.pipeline import Execution, Pipeline
from quern.plans.query import Query
from quern.sources.tables import Database


@dataclass(frozen=True)
class Request:
    """What a remote caller sends."""

    hash: str
    params: Mapping[str, Any] = field(default_factory=dict)
    mode: str = "all"
    name: str | None = None

    @staticmethod
    def of(query: Query, params: Mapping[str, Any] | None = None, mode: str = "all") -> Request:
        """Context values are stripped: the server has its own."""
        return Request(query.hash, {k: v for k, v in (params or {}).items() if v is not CONTEXT_VALUE}, mode, query.label)

    def to_json(self) -> str:
        return json.dumps({"hash": self.hash, "params": self.params, "mode": self.mode, "name": self.name}, default=str)

    @staticmethod
    def from_json(text: str) -> Request:
        try:
            raw = json.loads(text)
            return Request(raw["hash"], raw.get("params") or {}, raw.get("mode") or "all", raw.get("name"))
        except (ValueError, KeyError, TypeError) as e:
            raise QueryError(ErrorCode.QUERY_NOT_FOUND, "not a request") from e


class QueryRegistry:
    """strict: parameters that a query doesn't have are left out before it runs."""

    def __init__(self, database: Callable[[], Database], pipeline: Pipeline | None = None, strict: bool = True):
        self.database, self.pipeline, self.strict = database, pipeline or Pipeline(), strict
        self._queries: dict[str, Query] = {}

    def register(self, *queries: Query) -> None:
        for q in queries:
            self._queries[q.hash] = q

    def check(self) -> None:
        self.pipeline.check_authorization(list(self._queries.values()))

    def get(self, hash_: str) -> Query:
        if hash_ not in self._queries:
            raise QueryError(ErrorCode.QUERY_NOT_FOUND, f"no query {hash_[:12]}")
        return self._queries[hash_]

    def execute(self, request: Request | str, context: Mapping[str, Any] | None = None) -> Any:
        """Rows, a row or None, by the request's mode. Dotted context names are merged by path."""
        request = Request.from_json(request) if isinstance(request, str) else request
        query = self.get(request.hash)
        if request.mode not in ("all", "one", "first", "any"):
            raise QueryError(ErrorCode.QUERY_NOT_FOUND, f"no mode {request.mode!r}")
        params = dict(request.params)
        wanted = query.parameters()
        if self.strict:
            names = {p.name.split(".")[0] for p in wanted if not p.context}
            params = {k: v for k, v in params.items() if k in names}
        given: dict[str, Any] = {}
        for name, value in (context or {}).items():
            given = merge(given, name, value)
        db = self.database()
        run = Run(query, db, params, given)
        e = Execution(query.label or request.name, query.hash, query.all_tags, params, given, request.mode)

        def call() -> Any:
            e.sql = query.to_sql(db, params, given)[0]
            return getattr(run, request.mode)()

        return self.pipeline.execute(e, call)


class LocalClient:
    """Runs registered queries through their wire form, as a remote client would; transport is any function of the request's text."""

    def __init__(self, transport: Callable[[str], Any]):
        self.transport = transport

    def run(self, query: Query, params: Mapping[str, Any] | None = None, mode: str = "all") -> Any:
        return self.transport(Request.of(query, params, mode).to_json())
