"""What surrounds an execution: authorization, checks, limits, retries, audit, and hooks that see it begin and end."""

from __future__ import annotations

import threading
import time
from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from quern.errors import ErrorCode, QueryError
from quern.plans.execution import Retry


@dataclass
class Execution:
    """One run of a query: what hooks get. context is the caller's, as the server knows it."""

    name: str | None
    hash: str
    tags: tuple[str, ...]
    params: Mapping[str, Any]
    context: Mapping[str, Any]
    mode: str = "all"
    started: float = field(default_factory=time.monotonic)
    seconds: float = 0.0
    attempts: int = 0
    error: Exception | None = None
    sql: str | None = None


class Plugin:
    """Hooks, all optional. authorize returns whether one of the query's tags allows the context; the others raise to stop."""

    authorize: Callable[[Execution], bool] | None = None

    def init(self, e: Execution) -> None: ...

    def check(self, e: Execution) -> None: ...

    def before(self, e: Execution) -> None: ...

    def end(self, e: Execution) -> None: ...


class Pipeline:
    """init, authorize, check, then for each attempt: a place, before, the query; end in any case.

    Queries with tags need an authorize hook that says yes; without any such hook they are denied.
    """

    def __init__(self, plugins: Sequence[Plugin] = (), max_concurrent: int | None = None, retry: Retry = Retry()):
        self.plugins, self.retry = list(plugins), retry
        self._places = threading.BoundedSemaphore(max_concurrent) if max_concurrent else None

    def _authorizers(self) -> list[Callable[[Execution], bool]]:
        return [p.authorize for p in self.plugins if p.authorize is not None]

    def check_authorization(self, queries: Sequence[Any]) -> None:
        """At start: refuses tagged queries that no hook could let through."""
        if not self._authorizers() and (tagged := [q.label or q.hash[:8] for q in queries if q.all_tags]):
            raise QueryError(ErrorCode.UNAUTHORIZED, f"no authorize hook for the tagged queries {tagged}")

    def execute(self, e: Execution, call: Callable[[], Any]) -> Any:
        begun: list[Plugin] = []

        def attempt() -> Any:
            e.attempts += 1
            if self._places is not None and not self._places.acquire(blocking=False):
                raise QueryError(ErrorCode.RATE_LIMITED, "too many queries at once", retryable=True)
            try:
                for p in self.plugins:
                    p.before(e)
                return call()
            finally:
                if self._places is not None:
                    self._places.release()

        try:
            for p in self.plugins:
                begun.append(p)
                p.init(e)
            if e.tags:
                hooks = self._authorizers()
                if not hooks or not all(h(e) for h in hooks):
                    raise QueryError(ErrorCode.UNAUTHORIZED, f"{e.name or 'the query'} isn't allowed")
            for p in self.plugins:
                p.check(e)
            return self.retry.run(attempt)
        except Exception as error:
            e.error = error
            raise
        finally:
            e.seconds = time.monotonic() - e.started
            for p in begun:
                p.end(e)


class Authorizer(Plugin):
    """Lets a query through if allow(tag, context) is true of one of its tags."""

    def __init__(self, allow: Callable[[str, Mapping[str, Any]], bool]):
        self.authorize = lambda e: any(allow(t, e.context) for t in e.tags)


@dataclass
class Usage:
    running: int = 0
    total: int = 0
    seen: float = field(default_factory=time.monotonic)


class RateLimiter(Plugin):
    """Caps on runs at a time by query and by context; limit sees both usages and may refuse. Idle entries go after ttl seconds."""

    def __init__(self, per_query: int | None = None, per_context: int | None = None, key: Callable[[Mapping[str, Any]], str] = lambda c: str(c.get("user", "")), limit: Callable[[Execution, Usage, Usage], bool] | None = None, ttl: float = 300.0):
        self.per_query, self.per_context, self.key, self.limit, self.ttl = per_query, per_context, key, limit, ttl
        self.queries: dict[str, Usage] = defaultdict(Usage)
        self.contexts: dict[str, Usage] = defaultdict(Usage)
        self._lock, self._in = threading.Lock(), set()

    def check(self, e: Execution) -> None:
        with self._lock:
            now = time.monotonic()
            for known in (self.queries, self.contexts):
                for k in [k for k, u in known.items() if not u.running and now - u.seen > self.ttl]:
                    del known[k]
            q, c = self.queries[e.hash], self.contexts[self.key(e.context)]
            if (self.per_query is not None and q.running >= self.per_query) or (self.per_context is not None and c.running >= self.per_context) or (self.limit is not None and not self.limit(e, q, c)):
                raise QueryError(ErrorCode.RATE_LIMITED, f"{e.name or 'the query'} runs too often at once", retryable=True)
            for u in (q, c):
                u.running, u.total, u.seen = u.running + 1, u.total + 1, now
            self._in.add(id(e))

    def end(self, e: Execution) -> None:
        with self._lock:
            if id(e) in self._in:
                self._in.discard(id(e))
                for u in (self.queries[e.hash], self.contexts[self.key(e.context)]):
                    u.running, u.seen = u.running - 1, time.monotonic()


class AuditLog(Plugin):
    """One record a run, when it ends. The context stays out unless a resolver picks what to record of it."""

    def __init__(self, write: Callable[[dict], None], resolve: Callable[[Mapping[str, Any]], Any] | None = None):
        self.write, self.resolve = write, resolve

    def end(self, e: Execution) -> None:
        record = {"query": e.name, "hash": e.hash, "seconds": e.seconds, "attempts": e.attempts, "ok": e.error is None}
        if e.error is not None:
            record["error"] = getattr(getattr(e.error, "code", None), "value", type(e.error).__name__)
        if self.resolve is not None:
            record["context"] = self.resolve(e.context)
        self.write(record)


class Tracing(Plugin):
    """Spans of any tracer with start_span(name) whose spans have set_attribute, record_exception and end."""

    def __init__(self, tracer: Any):
        self.tracer, self._spans = tracer, {}

    def init(self, e: Execution) -> None:
        self._spans[id(e)] = self.tracer.start_span(e.name or "query")

    def end(self, e: Execution) -> None:
        span = self._spans.pop(id(e))
        span.set_attribute("db.statement", e.sql or "")
        span.set_attribute("query.hash", e.hash)
        if e.error is not None:
            span.record_exception(e.error)
        span.end()
