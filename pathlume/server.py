"""The HTTP interface over ``Lume``, on the standard library's server."""

from __future__ import annotations

import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pathlume.api import Lume
from pathlume.sources.catalog import ValidationMode

ONE = re.compile(r"/datasets/([^/]+)/(unregister|schema|parts|query|empty-query)")


def _yes(options: dict, name: str) -> bool:
    return options.get(name, ["false"])[0].lower() in ("true", "1", "yes")


def _true(value: object) -> bool:
    """Of a JSON value: true, and texts that say so."""
    return value is True or (isinstance(value, str) and value.lower() in ("true", "1", "yes"))


class Handler(BaseHTTPRequestHandler):
    lume: Lume

    def log_message(self, *_args) -> None:
        """Nothing is logged for requests that were answered."""

    def _answer(self, document: object, status: int = 200) -> None:
        body = json.dumps(document).encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def _body(self) -> object:
        length = int(self.headers.get("Content-Length") or 0)
        return json.loads(self.rfile.read(length)) if length else {}

    def _stream(self, documents) -> None:
        """A line of JSON for each document; the connection's end is the answer's."""
        self.send_response(200)
        self.send_header("Content-Type", "application/x-ndjson")
        self.end_headers()
        for d in documents:
            self.wfile.write(json.dumps(d).encode() + b"\n")
            self.wfile.flush()
        self.close_connection = True

    def _query(self, name: str, query: dict, options: dict) -> None:
        if _yes(options, "stream"):
            self._stream(self.lume.stream_query(name, query))
        else:
            found = self.lume.run_query(name, query)
            self._answer(found, 200 if found["success"] else 400)

    def do_GET(self) -> None:  # noqa: N802
        parts = urlsplit(self.path)
        options, found = parse_qs(parts.query), ONE.fullmatch(parts.path)
        if parts.path == "/datasets":
            self._answer(self.lume.list_datasets())
        elif not found or found[2] not in ("schema", "parts", "empty-query"):
            self._answer({"errorMessage": "no such place"}, 404)
        elif self.lume.get_dataset(found[1]) is None:
            self._answer({"errorMessage": f"there is no dataset {found[1]}"}, 404)
        elif found[2] == "schema":
            self._answer(self.lume.get_dataset_schema(found[1], _yes(options, "full")))
        elif found[2] == "parts":
            self._answer(self.lume.get_dataset_parts(found[1]))
        else:
            self._query(found[1], {}, options)

    def do_POST(self) -> None:  # noqa: N802
        parts = urlsplit(self.path)
        options, found = parse_qs(parts.query), ONE.fullmatch(parts.path)
        try:
            body = self._body()
        except ValueError:
            return self._answer({"errorMessage": "the body is no JSON"}, 400)
        if not isinstance(body, dict):
            return self._answer({"success": False, "errorMessage": "the body must be an object"}, 400)
        if parts.path == "/datasets/register":
            return self._register(body)
        if found and found[2] == "unregister":
            return self._answer(self.lume.unregister_dataset(found[1], _true(body.get("force"))))
        if found and found[2] == "query":
            return self._query(found[1], body, options)
        return self._answer({"errorMessage": "no such place"}, 404)

    def _register(self, body: dict) -> None:
        needed = ("name", "basepath", "groupIdColumn", "timestampColumn")
        if missing := [k for k in needed if k not in body]:
            return self._answer({"success": False, "errorMessage": f"lacks {', '.join(missing)}"}, 400)
        options = {"pattern": body["pattern"]} if "pattern" in body else {}
        if "validationMode" in body:
            try:
                options["mode"] = ValidationMode[str(body["validationMode"]).upper()]
            except KeyError:
                return self._answer({"success": False, "errorMessage": "no such validationMode"}, 400)
        if "validateUniques" in body:
            options["validate_uniques"] = _true(body["validateUniques"])
        found = self.lume.register_dataset(*(body[k] for k in needed), **options)
        return self._answer(found, 200 if found["success"] else 400)


def serve(lume: Lume, host: str = "127.0.0.1", port: int = 5000) -> ThreadingHTTPServer:
    """A server that answers once ``serve_forever`` is called."""
    return ThreadingHTTPServer((host, port), type("BoundHandler", (Handler,), {"lume": lume}))
