"""Errors with stable codes."""

from __future__ import annotations

from enum import Enum


class ErrorCode(str, Enum):
    BUILD_FAILED = "BUILD_FAILED"
    PARAM_VALIDATION_FAILED = "PARAM_VALIDATION_FAILED"
    QUERY_NOT_FOUND = "QUERY_NOT_FOUND"
    QUERY_FAILED = "QUERY_FAILED"
    QUERY_TIMEOUT = "QUERY_TIMEOUT"
    NOT_ONE_ROW = "NOT_ONE_ROW"
    UNAUTHORIZED = "UNAUTHORIZED"
    RATE_LIMITED = "RATE_LIMITED"
    CHECK_FAILED = "CHECK_FAILED"
    CONFLICT = "CONFLICT"
    MANIFEST_INVALID = "MANIFEST_INVALID"


class QueryError(Exception):
    """Any failure of a query; code says which, retryable whether trying again may help."""

    def __init__(self, code: ErrorCode, message: str, retryable: bool = False):
        super().__init__(f"{code.value}: {message}")
        self.code, self.retryable = code, retryable


def build_error(message: str) -> QueryError:
    return QueryError(ErrorCode.BUILD_FAILED, message)
