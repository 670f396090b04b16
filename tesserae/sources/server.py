"""Statements over HTTP: the text in `?query=` or the body, the form in `?format=`; `/ping` answers `Ok.`"""

from __future__ import annotations

from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import chain
from urllib.parse import parse_qs, urlsplit

from tesserae.plans.parser import parse
from tesserae.sources.catalog import Catalog
from tesserae.sources.formats import FORMATS, render, texts
from tesserae.types import DialectError

# Content types.
CONTENT = {"tabseparated": "text/tab-separated-values", "csv": "text/csv", "json": "application/json"}


def serve(catalog: Catalog, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is ready for serve_forever(); errors are 400 for text that does not parse, 500 otherwise.

    Rows are sent as they come from the executors. A result without rows is an empty line of plain text.
    """

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            self._answer("")

        def do_POST(self) -> None:  # noqa: N802
            self._answer(self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode())

        def _answer(self, body: str) -> None:
            url = urlsplit(self.path)
            if url.path == "/ping":
                return self._send(200, "text/plain", "Ok.\n")
            asked = parse_qs(url.query)
            text = asked.get("query", [""])[0] or body
            form = asked.get("format", [FORMATS[0]])[0]
            try:
                parse(text)
            except DialectError as e:
                return self._send(400, "text/plain", f"{e}\n")
            try:
                frame, kinds = catalog.execute(text)
                if frame.columns == ["message"]:
                    return self._send(200, "text/plain", f"{frame.first()[0]}\n")
                rows = texts(frame, kinds)
                first = next(rows, None)  # what fails, fails before the answer has begun
                if first is None:
                    return self._send(200, "text/plain", "\n")
                pieces = render(frame, kinds, form, chain([first], rows))
                head = next(pieces)
            except Exception as e:  # noqa: BLE001
                return self._send(500, "text/plain", f"{e}\n")
            self.send_response(200)
            self.send_header("Content-Type", f"{CONTENT[form.lower()]}; charset=utf-8")
            self.end_headers()  # no length: the answer ends with the connection
            for piece in chain([head], pieces):
                self.wfile.write(piece.encode())
            return None

        def _send(self, status: int, kind: str, text: str) -> None:
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
