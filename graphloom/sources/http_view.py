"""A thin server of a graph document and its summary, as a viewer asks for them."""

from __future__ import annotations

import os
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer


def make_server(graph_file: str, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """/api/graph and /api/summary give the files' bytes as JSON for any origin; a missing file is 404, an unreadable
    one 500. ``/`` names the two."""
    routes = {"/api/graph": graph_file, "/api/summary": graph_file + ".summary"}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            path = self.path.split("?")[0]
            if path == "/":
                return self._send(200, b'{"routes": ["/api/graph", "/api/summary"]}')
            file = routes.get(path)
            if file is None or not os.path.exists(file):
                return self._send(404, b'{"error": "not found"}')
            try:
                with open(file, "rb") as f:
                    body = f.read()
            except OSError:
                return self._send(500, b'{"error": "unreadable"}')
            return self._send(200, body)

        def _send(self, status: int, body: bytes) -> None:
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: object) -> None:
            return

    return ThreadingHTTPServer((host, port), Handler)
