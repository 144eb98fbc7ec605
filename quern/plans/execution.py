"""Running queries: one, first and all; timeouts that cancel, retries, and what a run was."""

from __future__ import annotations

import threading
import time
import uuid
import weakref
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from quern.errors import ErrorCode, QueryError
from quern.sources.tables import Database

#: Messages of failures that may pass by themselves.
TRANSIENT = ("ExecutorLostFailure", "FetchFailed", "executor heartbeat", "Connection reset", "Connection refused", "Lost executor")


@dataclass
class Rows:
    """Collected rows as dictionaries."""

    rows: list[dict]
    columns: list[str]

    def __iter__(self):
        return iter(self.rows)

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> dict:
        return self.rows[i]


@dataclass(frozen=True)
class Meta:
    sql: str | None
    params: Mapping[str, Any]
    seconds: float
    name: str | None


_META: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def meta_of(result: Any) -> Meta | None:
    return _META.get(result)


@dataclass(frozen=True)
class Retry:
    """attempts in all; delay in seconds or a function of the attempt; should_retry of the error."""

    attempts: int = 1
    delay: float | Callable[[int], float] = 0.0
    should_retry: Callable[[Exception], bool] = field(default=lambda e: isinstance(e, QueryError) and e.retryable)

    def run(self, call: Callable[[], Any]) -> Any:
        for attempt in range(1, max(1, self.attempts) + 1):
            try:
                return call()
            except Exception as e:
                if attempt >= self.attempts or not self.should_retry(e):
                    raise
                time.sleep(self.delay(attempt) if callable(self.delay) else self.delay)
        raise AssertionError


def run_error(e: Exception) -> QueryError:
    if isinstance(e, QueryError):
        return e
    text = str(e)
    return QueryError(ErrorCode.QUERY_FAILED, text[:2000], retryable=any(t in text for t in TRANSIENT))


def within(spark, seconds: float | None, call: Callable[[], Any]) -> Any:
    """call's result; after seconds, its Spark jobs are cancelled and QUERY_TIMEOUT is raised."""
    if seconds is None:
        return call()
    sc = spark.sparkContext
    tag, late = f"quern-{uuid.uuid4().hex}", threading.Event()

    done = threading.Event()

    def stop() -> None:
        # again and again: a job may start after a first cancellation, as planning goes on
        late.set()
        while not done.is_set():
            sc.cancelJobsWithTag(tag)
            done.wait(0.3)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    sc.setInterruptOnCancel(True)
    timer.start()
    try:
        out = call()
    except Exception as e:
        if late.is_set():
            raise QueryError(ErrorCode.QUERY_TIMEOUT, f"took more than {seconds} s") from e
        raise
    finally:
        done.set()
        timer.cancel()
        sc.setInterruptOnCancel(False)
        sc.removeJobTag(tag)
    if late.is_set():
        raise QueryError(ErrorCode.QUERY_TIMEOUT, f"took more than {seconds} s")
    return out


@dataclass(frozen=True)
class Run:
    """A query with all it needs; dataframe() is lazy, the others act."""

    query: Any
    db: Database
    params: Mapping[str, Any] = field(default_factory=dict)
    context: Mapping[str, Any] = field(default_factory=dict)
    timeout: float | None = None
    retry: Retry = Retry()

    def dataframe(self) -> DataFrame:
        label = getattr(self.query, "label", None)
        if label:
            self.db.spark.sparkContext.setJobDescription(label)
        return self.query.dataframe(self.db, self.params, self.context)

    def _collect(self, limit: int | None) -> Rows:
        began = time.monotonic()

        def act() -> Rows:
            try:
                df = self.dataframe()
                df = df if limit is None else df.limit(limit)
                return Rows([r.asDict(recursive=True) for r in df.collect()], df.columns)
            except Exception as e:
                raise run_error(e) from e

        out = self.retry.run(lambda: within(self.db.spark, self.timeout, act))
        text = self.query.to_sql(self.db, self.params, self.context)[0] if hasattr(self.query, "to_sql") else None
        _META[out] = Meta(text, dict(self.params), time.monotonic() - began, getattr(self.query, "label", None))
        return out

    def all(self) -> Rows:
        return self._collect(None)

    def first(self) -> dict | None:
        rows = self._collect(1)
        return rows[0] if rows else None

    any = first

    def one(self) -> dict:
        rows = self._collect(2)
        if len(rows) != 1:
            raise QueryError(ErrorCode.NOT_ONE_ROW, f"{'more than one row' if rows else 'no row'} instead of one")
        return rows[0]


Rows.__hash__ = object.__hash__  # type: ignore[method-assign]
