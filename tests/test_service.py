"""Requests to the service, straight and over a socket."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from folioscope.decode.document import from_texts
from folioscope.engine import Engine
from folioscope.service import POSTS, Service, server


@pytest.fixture(params=[False, True], ids=["envelopes", "strict"])
def service(spark, tmp_path, request):
    return Service(Engine(spark, strict=request.param), str(tmp_path / "store"), largest=100_000)


def ask(service, method, target, body=None, **kind):
    status, content_type, payload = service.answer(method, target, body if isinstance(body, bytes) else json.dumps(body).encode(), **kind)
    return status, json.loads(payload) if content_type == "application/json" else payload


def test_documents_and_operations(service, tmp_path):
    path = str(tmp_path / "a.pdf")
    with open(path, "wb") as f:
        f.write(from_texts(["alpha beta", "gamma", "alpha"]))
    assert ask(service, "GET", "/health")[0] == 200 and len(ask(service, "GET", "/v1/capabilities")[1]["data"]["operations"]) == 14
    assert ask(service, "POST", "/v1/documents/register", {"path": path})[1]["data"]["document"]["id"] == "doc-1"
    status, r = ask(service, "POST", "/v1/search", {"document": "doc-1", "keywords": ["alpha"], "pages": "1-2"})
    assert status == 200 and r["operation"] == "search" and r["data"]["totals"] == {"alpha": 1}
    assert ask(service, "POST", "/v1/pages/context", {"document": "doc-1", "anchor": 2, "before": 0})[1]["data"]["pages"] == [2, 3]
    out = str(tmp_path / "store" / "cut.pdf")
    assert ask(service, "POST", "/v1/pages/cut", {"document": "doc-1", "pages": "3", "output": out})[0] == 200
    assert ask(service, "GET", f"/v1/files?path={out}")[1][:5] == b"%PDF-"
    assert ask(service, "GET", "/v1/documents/doc-1")[1]["data"]["document"]["page_count"] == 3
    assert ask(service, "DELETE", "/v1/documents/doc-1?delete_files=true")[1]["data"] == {"removed": "doc-1", "filename": "a.pdf"}  # not an upload: it stays
    assert (tmp_path / "a.pdf").is_file() and ask(service, "GET", "/v1/documents")[1]["data"]["documents"] == []


def test_errors(service, tmp_path):
    for path, (operation, _) in POSTS.items():
        for body in ({}, b"no json", [1]):
            status, r = ask(service, "POST", path, body)
            assert status == 400 and r["operation"] == operation and r["error"]["code"] == "invalid_input"
    assert ask(service, "POST", "/v1/search", {"document": "doc-9", "keywords": "x"})[0] == 404
    assert ask(service, "POST", "/v1/speech/synthesize", {"text": "a", "speak_aloud": True})[0] == 503
    assert ask(service, "GET", "/v1/nothing")[0] == ask(service, "PUT", "/v1/documents")[0] == 404
    (tmp_path / "store-beside").mkdir()
    (tmp_path / "store-beside" / "x").write_text("secret")
    for path in (f"{tmp_path}/store-beside/x", f"{tmp_path}/store/../store-beside/x", "/etc/passwd"):
        assert ask(service, "GET", f"/v1/files?path={path}")[0] == 403
    assert ask(service, "GET", f"/v1/files?path={tmp_path}/store/none")[0] == 404


def test_uploads(service, tmp_path):
    data, store = from_texts(["alpha"]), tmp_path / "store"
    status, r = ask(service, "POST", "/v1/documents/upload?filename=../../b%20c.pdf", data)
    stored = r["data"]["stored_path"]
    assert status == 200 and r["data"]["size_bytes"] == len(data) and stored.endswith("_b_c.pdf") and [str(x) for x in store.iterdir()] == [stored]
    form = b'--XX\r\nContent-Disposition: form-data; name="file"; filename="f.pdf"\r\nContent-Type: application/pdf\r\n\r\n' + data + b"\r\n--XX--\r\n"
    r = ask(service, "POST", "/v1/documents/upload", form, content_type="multipart/form-data; boundary=XX")[1]["data"]
    with open(r["stored_path"], "rb") as f:
        assert f.read() == data and r["original_name"] == "f.pdf" and r["document"]["page_count"] == 1
    assert ask(service, "DELETE", f"/v1/documents/{r['document']['id']}?delete_files=1")[1]["data"]["deleted_file"] == r["stored_path"]
    for name, body in (("x.txt", data), ("", data), ("x.pdf", b"junk"), ("x.pdf", data + b" " * 100_000)):
        assert ask(service, "POST", f"/v1/documents/upload?filename={name}", body)[0] == 400
    assert [str(x) for x in store.iterdir()] == [stored]


def test_over_a_socket(spark, tmp_path):
    s = server(Service(Engine(spark), str(tmp_path), largest=1000), port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{s.server_port}"
    try:
        with urllib.request.urlopen(f"{at}/health", timeout=20) as r:
            assert json.load(r)["ok"]
        wrong = urllib.request.Request(f"{at}/v1/merge", b"{}", {"Content-Type": "application/json"})
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(wrong, timeout=20)
        assert e.value.code == 400 and json.load(e.value)["operation"] == "merge"
    finally:
        s.shutdown()
        s.server_close()


def test_a_cluster_needs_a_folder_that_executors_reach():
    from types import SimpleNamespace

    from folioscope.errors import ValidationError

    engine = SimpleNamespace(spark=SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077")))
    with pytest.raises(ValidationError):
        Service(engine)
