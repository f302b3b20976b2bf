"""Tokens of document bytes, found by one compiled pattern."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

_REGULAR = rb"[^\x00\t\n\f\r ()<>\[\]{}/%]"
_TOKEN = re.compile(
    rb"(?:[\x00\t\n\f\r {}]|%[^\r\n]*|>(?!>))*"
    rb"(?:(?P<DictStart><<)|(?P<DictEnd>>>)|(?P<HexStr><[^>]*>?)|(?P<StringLit>\()|(?P<ArrayStart>\[)|(?P<ArrayEnd>\])"
    rb"|(?P<Name>/" + _REGULAR + rb"*)|(?P<Number>[0-9+.\-]" + _REGULAR + rb"*)|(?P<Keyword>" + _REGULAR + rb"+)|\)|\Z)"
)
_PAREN = re.compile(rb"\\.|[()]", re.S)
_REAL = re.compile(rb"-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_WHOLE = re.compile(rb"-?[0-9]+")
LEAST, MOST = -(2**63), 2**63 - 1


class Token(NamedTuple):
    pos: int
    type: str
    value: bytes
    int_val: int
    float_val: float

    @property
    def number(self) -> float:
        return float(self.int_val) if self.type == "Integer" else self.float_val


def single(x: float) -> float:
    """Rounded to 32 bits; too large values become infinite."""
    try:
        return struct.unpack("<f", struct.pack("<f", x))[0]
    except OverflowError:
        return float("inf") if x > 0 else float("-inf")


def _string_end(data: bytes, at: int) -> int:
    depth = 0
    for m in _PAREN.finditer(data, at):
        if m[0] == b"(":
            depth += 1
        elif m[0] == b")":
            depth -= 1
            if not depth:
                return m.end()
    return len(data)


def _number(pos: int, raw: bytes) -> Token:
    if re.search(rb"[.eE]", raw):
        m = _REAL.match(raw)
        return Token(pos, "Real", raw, 0, single(float(m[0])) if m else 0.0)
    m = _WHOLE.match(raw[1:] if raw[:1] == b"+" else raw)
    return Token(pos, "Integer", raw, min(max(int(m[0]), LEAST), MOST) if m else 0, 0.0)


def tokens(data: bytes, at: int = 0, end: int | None = None) -> Iterator[Token]:
    """Tokens from ``at``; white space, comments, braces and stray closing marks are passed over."""
    end = len(data) if end is None else end
    while at < end:
        m = _TOKEN.match(data, at, end)
        if m is None:
            return
        at, kind = m.end(), m.lastgroup
        if kind is None:
            if m.end() == m.start():
                return
            continue
        start, raw = m.start(kind), m[kind]
        if kind == "StringLit":
            at = min(_string_end(data, start), end)
            yield Token(start, kind, data[start:at], 0, 0.0)
        elif kind == "Number":
            yield _number(start, raw)
        elif kind == "Keyword" and raw in (b"stream", b"endstream"):
            yield Token(start, "StreamStart" if raw == b"stream" else "StreamEnd", raw, 0, 0.0)
        else:
            yield Token(start, kind, raw, 0, 0.0)


_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|\r|\n)|(.)|\Z)|\r\n?", re.S)


def _unescape(m: re.Match[bytes]) -> bytes:
    if m[0][:1] == b"\r":
        return b"\n"
    if m[1]:
        return bytes([int(m[1], 8) % 256])
    return b"" if m[2] or not m[3] else _ESCAPES.get(m[3], m[3])


def string_bytes(raw: bytes) -> bytes:
    """What a literal or hexadecimal string stands for."""
    if raw[:1] == b"<":
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return _ESCAPE.sub(_unescape, raw[1:-1] if raw.endswith(b")") else raw[1:])


def name_text(raw: bytes) -> str:
    """A name without its slash, hexadecimal escapes resolved."""
    return re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw[1:]).decode("latin-1")
