"""An HTTP push source: one record for each POST or PUT, acknowledged (204) once its micro-batch is committed."""

from __future__ import annotations

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "id long, arrived double, headers map<string,string>, body binary"
_INBOXES: dict[int, Inbox] = {}


class Inbox:
    """Arrivals that wait to be read, read ones that wait to be committed, and who waits for them."""

    def __init__(self, port: int, limit: int, timeout: float, host: str = "127.0.0.1", most_bytes: int = 1 << 20, key_headers: tuple[str, ...] = ("Idempotency-Key",), first_id: int = 0):
        self.limit, self.timeout, self.most_bytes, self.key_headers = limit, timeout, most_bytes, key_headers
        self.lock, self.next_id = threading.Condition(), first_id
        self.rows: dict[int, tuple] = {}
        self.waiters: dict[int, threading.Event] = {}
        self.keys: dict[str, int] = {}
        inbox = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                length = self.headers.get("Content-Length", "")
                if not length.isdecimal() or int(length) > inbox.most_bytes:
                    status, self.close_connection = (413 if length.isdecimal() else 411), True  # the body is not read
                else:
                    status = inbox.offer(dict(self.headers.items()), self.rfile.read(int(length)))
                self.send_response(status)
                if status in (429, 503):
                    self.send_header("Retry-After", "1")
                self.send_header("Content-Length", "0")
                self.end_headers()

            do_PUT = do_POST

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.port = self.server.server_address[1]
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def key(self, headers: dict) -> str | None:
        """The first key header that is given."""
        given = {k.lower(): v for k, v in headers.items()}
        return next((given[h.lower()] for h in self.key_headers if given.get(h.lower())), None)

    def offer(self, headers: dict, body: bytes) -> int:
        """204 once the record is committed, 429 where too many wait, 503 after the time limit. A request with the given key of one that still
        waits is that one: it waits for the same commit."""
        key = self.key(headers)
        with self.lock:
            i = self.keys.get(key) if key else None
            if i is None:
                if len(self.rows) >= self.limit:
                    return 429
                i, self.next_id = self.next_id, self.next_id + 1
                self.waiters[i] = threading.Event()
                if key:
                    self.keys[key] = i
                self.rows[i] = (i, time.time(), headers, body)
            done = self.waiters[i]
        return 204 if done.wait(self.timeout) else 503

    def between(self, start: int, end: int) -> list[tuple]:
        with self.lock:
            return [row for i, row in sorted(self.rows.items()) if start <= i < end]

    def settle(self, end: int) -> None:
        with self.lock:
            for i in [i for i in self.rows if i < end]:
                del self.rows[i]
                self.waiters.pop(i).set()
            self.keys = {k: i for k, i in self.keys.items() if i >= end}


class PushStream(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.options = dict(options)

    @property
    def inbox(self) -> Inbox:
        port = int(self.options["port"])
        if port not in _INBOXES:
            more = {"host": self.options.get("host", "127.0.0.1"), "most_bytes": int(self.options.get("max_body", 1 << 20))}
            more["first_id"] = time.time_ns() // 1000  # above all ids of an earlier run
            _INBOXES[port] = Inbox(port, int(self.options.get("limit", 1000)), float(self.options.get("ack_timeout", 30)), **more)
        return _INBOXES[port]

    def initialOffset(self):
        return {"id": 0}

    def read(self, start):
        """New records. A batch is committed when the next one is planned, so while read records wait for that the offset moves on by one,
        which makes Spark plan a batch without rows."""
        inbox = self.inbox
        with inbox.lock:
            end = max(start["id"], max(inbox.rows, default=-1) + 1)
            if end == start["id"] and inbox.rows:
                end += 1
                inbox.next_id = max(inbox.next_id, end)
        return iter(inbox.between(start["id"], end)), {"id": end}

    def readBetweenOffsets(self, start, end):
        """Asked for where a batch is run again after a restart: its records were not acknowledged, so their senders send them again."""
        inbox = _INBOXES.get(int(self.options["port"]))
        return iter(inbox.between(start["id"], end["id"]) if inbox else ())

    def commit(self, end):
        self.inbox.settle(end["id"])


class Push(DataSource):
    @classmethod
    def name(cls):
        return "http_push"

    def schema(self):
        return SCHEMA

    def simpleStreamReader(self, schema):
        return PushStream(self.options)
