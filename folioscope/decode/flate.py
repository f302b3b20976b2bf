"""Guarded inflation of zlib data."""

from __future__ import annotations

import zlib

#: Most bytes out for a byte in, and in all.
RATIO = 128
LARGEST = 64 << 20


def inflate(data: bytes, hint: int | None = None) -> tuple[str, bytes]:
    """("ok" | "bad_data" | "limit_exceeded", bytes); nothing is returned with an error."""
    cap = min(LARGEST, max(RATIO * len(data), 1), hint if hint is not None else LARGEST)
    engine = zlib.decompressobj()
    try:
        out = engine.decompress(data, cap + 1)
    except zlib.error:
        return "bad_data", b""
    if len(out) > cap:
        return "limit_exceeded", b""
    return ("ok", out) if engine.eof else ("bad_data", b"")
