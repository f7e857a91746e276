"""A small HTTP interface: GET /search?q=...&k=10 and GET /stats, in JSON."""

from __future__ import annotations

import json
import math
import threading
import time
from collections.abc import Sequence
from http.client import HTTPConnection, HTTPException
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, quote, urlsplit

from .search_index import SearchIndex


def answer(index: SearchIndex, target: str) -> tuple[int, dict]:
    """(status, body) for a request's path and query."""
    url = urlsplit(target)
    args = parse_qs(url.query, keep_blank_values=True)
    if url.path == "/stats":
        return 200, index.stats()
    if url.path != "/search":
        return 404, {"error": "unknown path"}
    if "q" not in args:
        return 400, {"error": "q is missing"}
    try:
        k = int(args.get("k", ["10"])[0])
        if k < 0:
            raise ValueError
    except ValueError:
        return 400, {"error": "k is no whole number"}
    got = index.run(args["q"][0], k)
    rows = [{"id": r["id"], "score": r["score"], "title": r["title"]} for r in got.results]
    return 200, {"query": got.query, "took_ms": got.took_ms, **vars(index.work(got.query)), "results": rows}


def server(index: SearchIndex, addr: str) -> ThreadingHTTPServer:
    host, _, port = addr.rpartition(":")

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, body = answer(index, self.path)
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, int(port)), Handler)


def serve(index: SearchIndex, addr: str = "127.0.0.1:8080") -> None:
    server(index, addr).serve_forever()


def load(addr: str, queries: Sequence[str], connections: int = 32, seconds: float = 10.0, k: int = 10) -> dict:
    """Asks a server for ``seconds`` over several connections, each going through all queries in turn.

    Returns requests, errors (no answer, or a status that isn't 200), requests a
    second, and nearest-rank percentiles of the answered ones in milliseconds.
    """
    if not queries:
        raise ValueError("no query to ask")
    host, _, port = addr.rpartition(":")
    took, errors, lock = [], [0], threading.Lock()
    start = time.perf_counter()

    def ask(first: int) -> None:
        link, turn, mine, failed = HTTPConnection(host, int(port), timeout=60), first, [], 0
        while time.perf_counter() - start < seconds:
            begun = time.perf_counter()
            try:
                link.request("GET", f"/search?q={quote(queries[turn % len(queries)])}&k={k}")
                answered = link.getresponse()
                answered.read()
                good = answered.status == 200
            except (OSError, HTTPException):
                link.close()
                good = False
            if good:
                mine.append(time.perf_counter() - begun)
            else:
                failed += 1
            turn += 1
        link.close()
        with lock:
            took.extend(mine)
            errors[0] += failed

    threads = [threading.Thread(target=ask, args=(n * len(queries) // connections,)) for n in range(connections)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    ran, took = time.perf_counter() - start, sorted(took)
    at = lambda p: round(1000 * took[math.ceil(p * len(took)) - 1], 3) if took else None
    return {"requests": len(took), "errors": errors[0], "per_second": round(len(took) / ran, 1), "p50_ms": at(0.5), "p95_ms": at(0.95), "p99_ms": at(0.99)}
