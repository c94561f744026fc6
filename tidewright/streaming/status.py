"""The read model of running queries over HTTP: /status as JSON, paged by query name, and /metrics as plain text."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

#: Rows of a page where no limit is given, and at most.
PAGE, MOST = 200, 1000


def query_rows(spark: SparkSession) -> list[dict]:
    """One row for each active query, by name; what is not reported is null, never 0."""
    out = []
    for q in spark.streams.active:
        last = q.lastProgress or {}
        out.append({
            "stream": q.name or q.id, "batch": last.get("batchId"), "records": last.get("numInputRows"), "per_second": last.get("processedRowsPerSecond"),
            "active": q.isActive, "fault": str(q.exception()) if q.exception() else None, "offsets": [s.get("endOffset") for s in last.get("sources", [])],
        })
    return sorted(out, key=lambda r: r["stream"])


def page(rows: list[dict], given: dict[str, list[str]]) -> dict:
    """The rows that a request's parameters ask for; a parameter that is unknown or makes no sense is a ValueError."""
    unknown = set(given) - {"stream", "limit", "cursor"}
    if unknown:
        raise ValueError(f"unknown parameter {sorted(unknown)[0]!r}")
    one = {k: v[-1] for k, v in given.items()}
    limit = one.get("limit", str(PAGE))
    if not limit.isdecimal() or int(limit) > MOST:
        raise ValueError(f"limit must be 0 to {MOST}")
    found = [r for r in rows if ("stream" not in one or r["stream"] == one["stream"]) and r["stream"] > one.get("cursor", "")]
    shown = found[: int(limit)]
    more = len(found) > len(shown)
    return {"rows": shown, "truncated": more, "cursor": shown[-1]["stream"] if more and shown else None}


def metrics(rows: list[dict]) -> str:
    """One line for each number that is reported; a series that cannot be measured is left out."""
    lines = []
    for name in ("records", "per_second", "batch"):
        for r in rows:
            if r[name] is not None:
                stream = r["stream"].replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
                lines.append(f'tidewright_{name}{{stream="{stream}"}} {r[name]:g}')
    return "\n".join([*lines, ""])


def serve(rows: Callable[[], list[dict]], port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server in a thread of its own; ``shutdown()`` ends it. 400 for a bad parameter, 404 for another path."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            at = urlsplit(self.path)
            kind, code = "application/json", 200
            if at.path == "/metrics":
                kind, body = "text/plain; version=0.0.4", metrics(rows())
            elif at.path == "/status":
                try:
                    body = json.dumps(page(rows(), parse_qs(at.query, keep_blank_values=True)))
                except ValueError as e:
                    code, body = 400, json.dumps({"error": str(e)})
            else:
                code, body = 404, json.dumps({"error": "there are /status and /metrics"})
            data = body.encode()
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
