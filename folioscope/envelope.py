"""The result envelope: ok, operation, data, error, engine."""

from __future__ import annotations

from typing import Any

from folioscope.errors import EngineError

ENGINE = {"name": "folioscope", "version": "0.1.0"}


def success(operation: str, data: Any) -> dict[str, Any]:
    return {"ok": True, "operation": operation, "data": data, "error": None, "engine": ENGINE}


def failure(operation: str, error: EngineError) -> dict[str, Any]:
    return {"ok": False, "operation": operation, "data": None, "error": error.to_dict(), "engine": ENGINE}
