"""An HTTP service over the engine: JSON bodies in, envelopes out; one table of routes and the standard library's server.

Uploads go to one folder, and only files of that folder can be downloaded or deleted. Whoever can reach the port can make
the engine read and write files, so the server listens on this machine alone unless told otherwise.
"""

from __future__ import annotations

import argparse
import email.parser
import email.policy
import json
import mimetypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import SparkSession

from folioscope import envelope, errors
from folioscope.engine import Engine

#: Bytes of an uploaded document, and of what a request may hold beside it.
LARGEST_UPLOAD = 100 << 20
BESIDE = 1 << 16
_NEEDED = object()
_AXES = {"pages": None, "case_sensitive": False, "whole_words": True}
_AROUND = {"before": 1, "after": 1}

#: Path to (operation, fields of the body with their defaults); ``document`` is the engine's ``reference``.
POSTS: dict[str, tuple[str, dict[str, Any]]] = {
    "/v1/documents/register": ("register", {"path": _NEEDED}),
    "/v1/search": ("search", {"document": _NEEDED, "keywords": _NEEDED, **_AXES}),
    "/v1/search/corpus": ("search_corpus", {"keywords": _NEEDED, "directory": None, "recursive": False, "sort": "path", **_AXES}),
    "/v1/extract/text": ("extract_text", {"document": _NEEDED, "pages": None}),
    "/v1/extract/links": ("extract_links", {"document": _NEEDED, "pages": None}),
    "/v1/pages/cut": ("cut_pages", {"document": _NEEDED, "pages": _NEEDED, "output": _NEEDED}),
    "/v1/pages/context": ("context_pages", {"document": _NEEDED, "anchor": _NEEDED, **_AROUND}),
    "/v1/pages/extract-context": ("extract_context", {"document": _NEEDED, "anchor": _NEEDED, "output": _NEEDED, **_AROUND}),
    "/v1/pages/extract-matches": ("extract_matches", {"document": _NEEDED, "keywords": _NEEDED, "output": _NEEDED, "padding": 2, **_AXES}),
    "/v1/merge": ("merge", {"inputs": _NEEDED, "output": _NEEDED}),
    "/v1/merge/folder": ("merge_folder", {"directory": _NEEDED, "output": None, "recursive": False, "numeric_prefix": False}),
    "/v1/render/pages": ("render_pages", {"document": _NEEDED, "pages": None, "dpi": 150}),
    "/v1/render/thumbnails": ("render_thumbnails", {"document": _NEEDED, "pages": None, "scale": 0.3}),
    "/v1/speech/synthesize": ("synthesize_speech", {"text": _NEEDED, "save_path": None, "speak_aloud": False, "rate": None, "volume": None}),
}
Answer = tuple[int, str, bytes]


def _statuses(kind: type = errors.EngineError) -> dict[str, int]:
    out = {kind.code: kind.http_status}
    for below in kind.__subclasses__():
        out |= _statuses(below)
    return out


def _said(result: dict[str, Any], status: int | None = None) -> Answer:
    if status is None:
        status = 200 if result["ok"] else _statuses().get(result["error"]["code"], 500)
    return status, "application/json", json.dumps(result, ensure_ascii=False).encode("utf-8")


class Service:
    """Answers requests, whatever brings them. ``folder`` takes uploads, which executors have to reach: only a local master
    may go without it."""

    def __init__(self, engine: Engine, folder: str | None = None, largest: int = LARGEST_UPLOAD):
        self.engine, self.largest = engine, largest
        master = engine.spark.sparkContext.master
        if folder is None and (not master.startswith("local") or master.startswith("local-cluster")):
            raise errors.ValidationError("name a folder for uploads that all executors can read")
        self.folder = os.path.realpath(folder or os.path.join(tempfile.gettempdir(), "folioscope-uploads"))
        os.makedirs(self.folder, exist_ok=True)

    def answer(self, method: str, target: str, body: bytes = b"", content_type: str = "application/json") -> Answer:
        """(status, content type, payload) of a request."""
        url = urlsplit(target)
        path, query = url.path.rstrip("/") or "/", {k: v[-1] for k, v in parse_qs(url.query).items()}
        if method == "POST" and path in POSTS:
            operation, fields = POSTS[path]
            return _said(self._guarded(operation, lambda: self._call(operation, fields, body)))
        if method == "POST" and path == "/v1/documents/upload":
            return _said(self._guarded("register", lambda: envelope.success("register", self._upload(query.get("filename"), body, content_type))))
        if method == "GET" and path == "/health":
            return _said({"ok": True, "engine": envelope.ENGINE})
        if method == "GET" and path in ("/v1/capabilities", "/v1/documents"):
            operation = "capabilities" if path.endswith("capabilities") else "list_documents"
            return _said(self._guarded(operation, getattr(self.engine, operation)))
        if method == "GET" and path == "/v1/files":
            return self._download(query.get("path", ""))
        if m := re.fullmatch(r"/v1/documents/([^/]+)", path):
            if method == "GET":
                return _said(self._guarded("document_info", lambda: self.engine.document_info(unquote(m[1]))))
            if method == "DELETE":
                also = query.get("delete_files", "").lower() in ("1", "true", "yes", "on")
                return _said(self._guarded("remove_document", lambda: envelope.success("remove_document", self._remove(unquote(m[1]), also))))
        return _said(envelope.failure("request", errors.ValidationError("no such route", {"method": method, "path": path})), 404)

    @staticmethod
    def _guarded(operation: str, work: Callable[[], dict[str, Any]]) -> dict[str, Any]:
        """An envelope even from a strict engine."""
        try:
            return work()
        except errors.EngineError as e:
            return envelope.failure(operation, e)
        except Exception as e:
            return envelope.failure(operation, errors.OperationError(str(e)))

    def _call(self, operation: str, fields: dict[str, Any], body: bytes) -> dict[str, Any]:
        try:
            given = json.loads(body)
        except ValueError:
            given = None
        given = given if isinstance(given, dict) else {}
        values = {}
        for field, default in fields.items():
            value = given.get(field, default)
            if value is _NEEDED or (value is None and default is _NEEDED):
                raise errors.ValidationError(f"the request lacks {field}", {"field": field})
            values["reference" if field == "document" else field] = bool(value) if isinstance(default, bool) else value
        return getattr(self.engine, operation)(**values)

    def _inside(self, path: str) -> bool:
        return os.path.commonpath([self.folder, os.path.realpath(path)]) == self.folder

    def _upload(self, name: str | None, body: bytes, content_type: str) -> dict[str, Any]:
        """Store a document, sent as it is with ?filename= or as the first file of a form, and register it."""
        if content_type.lower().startswith("multipart/"):
            form = email.parser.BytesParser(policy=email.policy.HTTP).parsebytes(b"Content-Type: " + content_type.encode("latin-1") + b"\r\n\r\n" + body)
            part = next((p for p in form.walk() if p.get_filename()), None)
            name, body = (None, b"") if part is None else (part.get_filename(), part.get_payload(decode=True))
        safe = re.sub(r"[^A-Za-z0-9._-]", "_", re.split(r"[\\/]", name or "")[-1]).strip("._")
        if not safe.lower().endswith(".pdf"):
            raise errors.ValidationError("an upload needs a name that ends in .pdf", {"filename": name})
        if len(body) > self.largest:
            raise errors.ValidationError("the upload is larger than allowed", {"max_bytes": self.largest})
        target = os.path.join(self.folder, f"{uuid.uuid4().hex}_{safe}")
        with open(target, "wb") as file:
            file.write(body)
        try:
            entry = self.engine.catalog.register(target)
        except Exception:
            os.unlink(target)
            raise
        return {"document": entry.to_dict(), "stored_path": target, "original_name": name, "size_bytes": len(body)}

    def _remove(self, reference: str, also: bool) -> dict[str, Any]:
        entry = self.engine.catalog.remove(reference)
        out = {"removed": entry.id, "filename": entry.filename}
        if also and self._inside(entry.path) and os.path.isfile(entry.path):
            os.unlink(entry.path)
            out["deleted_file"] = entry.path
        return out

    def _download(self, path: str) -> Answer:
        found = os.path.realpath(os.path.expanduser(path))
        if not self._inside(found):
            return _said(envelope.failure("download", errors.ValidationError("only uploaded files can be fetched", {"path": path})), 403)
        if not os.path.isfile(found):
            return _said(envelope.failure("download", errors.ValidationError("nothing is stored there", {"path": path})), 404)
        with open(found, "rb") as file:
            return 200, mimetypes.guess_type(found)[0] or "application/octet-stream", file.read()


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is ready to serve; port 0 takes any free one."""

    class Handler(BaseHTTPRequestHandler):
        def _any(self) -> None:
            length = self.headers.get("Content-Length") or "0"
            if not length.isdecimal() or int(length) > service.largest + BESIDE:
                self.close_connection = True
                answer = _said(envelope.failure("request", errors.ValidationError("the request is larger than allowed", {"max_bytes": service.largest})))
            else:
                answer = service.answer(self.command, self.path, self.rfile.read(int(length)), self.headers.get("Content-Type", ""))
            status, kind, payload = answer
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(payload)))
            self.end_headers()
            self.wfile.write(payload)

        do_GET = do_POST = do_DELETE = _any

        def log_message(self, *_: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(prog="folioscope-service")
    a.add_argument("--host", default="127.0.0.1")
    a.add_argument("--port", type=int, default=8000)
    a.add_argument("--folder")
    said = a.parse_args(argv)
    engine = Engine(SparkSession.builder.appName("folioscope").getOrCreate())
    server(Service(engine, said.folder), said.host, said.port).serve_forever()


if __name__ == "__main__":
    main()
