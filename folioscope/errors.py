"""Errors with a stable code and an HTTP status; they are raised before any plan runs."""

from __future__ import annotations

from typing import Any


class EngineError(Exception):
    code, http_status = "engine_error", 500

    def __init__(self, message: str, details: dict[str, Any] | None = None):
        super().__init__(message)
        self.message, self.details = message, dict(details or {})

    def to_dict(self) -> dict[str, Any]:
        return {"code": self.code, "message": self.message, "details": self.details}


class ValidationError(EngineError):
    code, http_status = "invalid_input", 400


class PageRangeError(ValidationError):
    code = "invalid_page_range"


class OutputConflictError(ValidationError):
    code = "output_conflict"


class UnreadableError(EngineError):
    code, http_status = "unreadable_pdf", 400


class DocumentNotFoundError(EngineError):
    code, http_status = "document_not_found", 404


class ContentNotFoundError(EngineError):
    code, http_status = "content_not_found", 404


class DependencyUnavailableError(EngineError):
    code, http_status = "dependency_unavailable", 503


class OperationError(EngineError):
    code, http_status = "operation_failed", 500
