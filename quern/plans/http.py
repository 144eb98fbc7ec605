"""A registry over HTTP: a request names a hash and parameters, never SQL."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from quern.errors import ErrorCode, QueryError
from quern.plans.registry import QueryRegistry

STATUS = {ErrorCode.QUERY_NOT_FOUND: 404, ErrorCode.UNAUTHORIZED: 403, ErrorCode.RATE_LIMITED: 429, ErrorCode.PARAM_VALIDATION_FAILED: 400, ErrorCode.BUILD_FAILED: 400, ErrorCode.QUERY_TIMEOUT: 504}


def serve(registry: QueryRegistry, context: Callable[[Mapping[str, str]], Mapping[str, Any]] = lambda headers: {}, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server (not yet running) that answers POSTs; context makes the server's values of a request's headers."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            try:
                text = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
                found = registry.execute(text, context(dict(self.headers)))
                status, body = 200, {"result": found if found is None or isinstance(found, dict) else list(found)}
            except QueryError as e:
                status, body = STATUS.get(e.code, 500), {"error": e.code.value, "message": str(e) if status_is_safe(e) else e.code.value}
            out = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def status_is_safe(e: QueryError) -> bool:
    """Failures of the engine may quote SQL, which callers don't see."""
    return e.code != ErrorCode.QUERY_FAILED


def http_transport(url: str, headers: Mapping[str, str] | None = None, timeout: float = 60.0) -> Callable[[str], Any]:
    """For LocalClient: sends a request's text to a server and returns its result."""

    def send(text: str) -> Any:
        request = urllib.request.Request(url, text.encode(), {"Content-Type": "application/json", **(headers or {})})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as response:
                return json.loads(response.read())["result"]
        except urllib.error.HTTPError as e:
            body = json.loads(e.read() or b"{}")
            raise QueryError(ErrorCode(body.get("error", "QUERY_FAILED")), body.get("message", "")) from e
        except urllib.error.URLError as e:
            raise QueryError(ErrorCode.QUERY_FAILED, str(e.reason), retryable=True) from e

    return send
