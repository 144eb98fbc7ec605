"""Parameters: named values with validation and defaults, and values that only the server puts in."""

from __future__ import annotations

import datetime
import decimal
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from quern.errors import ErrorCode, QueryError

MISSING = object()
BINDABLE = (str, int, float, bool, bytes, datetime.date, datetime.datetime, decimal.Decimal, type(None))


class _ContextValue:
    """Stands for a value that the server fills in; NULL where there is none."""

    def __repr__(self) -> str:
        return "CONTEXT_VALUE"


CONTEXT_VALUE = _ContextValue()


def lookup(values: Mapping[str, Any] | None, path: str) -> Any:
    """The value at a dotted path; MISSING if there is none."""
    if values is not None and path in values:
        return values[path]
    now: Any = values
    for part in path.split("."):
        if not isinstance(now, Mapping) or part not in now:
            return MISSING
        now = now[part]
    return now


def merge(values: Mapping[str, Any], path: str, value: Any) -> dict:
    """values with value at a dotted path."""
    first, _, rest = path.partition(".")
    out = dict(values)
    out[first] = merge(out.get(first) if isinstance(out.get(first), Mapping) else {}, rest, value) if rest else value
    return out


def invalid(message: str) -> QueryError:
    return QueryError(ErrorCode.PARAM_VALIDATION_FAILED, message)


@dataclass(frozen=True)
class Rules:
    """Limits of a value: lengths and pattern for text, least and greatest, allowed values, fields of an object, or a function."""

    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    least: Any = None
    greatest: Any = None
    values: tuple = ()
    fields: tuple[str, ...] = ()
    check: Callable[[Any], bool] | None = field(default=None, compare=False)

    def problem(self, value: Any) -> str | None:
        if isinstance(value, (list, tuple)):
            return next((p for v in value if (p := self.problem(v))), None)
        if self.fields and isinstance(value, Mapping):
            unknown = [k for k in value if k not in self.fields]
            return f"unknown fields {unknown}" if unknown else None
        if value is None:
            return None
        if isinstance(value, str):
            if self.min_length is not None and len(value) < self.min_length:
                return f"shorter than {self.min_length}"
            if self.max_length is not None and len(value) > self.max_length:
                return f"longer than {self.max_length}"
            if self.pattern is not None and not re.search(self.pattern, value):
                return "doesn't match the pattern"
        try:
            if self.least is not None and value < self.least:
                return f"less than {self.least}"
            if self.greatest is not None and value > self.greatest:
                return f"greater than {self.greatest}"
        except TypeError:
            return "of another type than its limits"
        if self.values and not any(type(v) is type(value) and v == value for v in self.values):
            return f"none of {list(self.values)}"
        if self.check is not None and not self.check(value):
            return "refused"
        return None


@dataclass(frozen=True)
class Param:
    """A named value. context: put in by the server, never by the caller. is_list says that it is a list, for hashes and manifests only."""

    name: str
    rules: Rules = Rules()
    default: Any = None
    has_default: bool = False
    context: bool = False

    def resolve(self, params: Mapping[str, Any] | None, context: Mapping[str, Any] | None) -> Any:
        """An absent or invalid value gives the default if there is one; an invalid one without default is an error."""
        value = lookup(context if self.context else params, self.name)
        if value is MISSING or value is CONTEXT_VALUE:
            return self.default if self.has_default else None
        if p := self.rules.problem(value):
            if self.has_default:
                return self.default
            raise invalid(f"{self.name} is {p}")
        return value


def param(name: str, default: Any = MISSING, **rules: Any) -> Param:
    rules = {k: tuple(v) if k in ("values", "fields") else v for k, v in rules.items()}
    return Param(name, Rules(**rules), None if default is MISSING else default, default is not MISSING)


def ctx(name: str) -> Param:
    return Param(name, context=True)


class _Input:
    """Attribute access that makes parameters: inputs().user.id is param("user.id")."""

    def __init__(self, path: str = ""):
        self._path = path

    def __getattr__(self, name: str) -> _Input:
        if name.startswith("_"):
            raise AttributeError(name)
        return _Input(f"{self._path}.{name}" if self._path else name)

    def __call__(self, default: Any = MISSING, **rules: Any) -> Param:
        return param(self._path, default, **rules)


def inputs() -> _Input:
    return _Input()
