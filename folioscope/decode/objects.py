"""Objects of a document: parsing, cross-references, streams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, NamedTuple

from folioscope.decode.flate import LARGEST
from folioscope.decode.lexer import Token, name_text, single, string_bytes, tokens

TAIL = 1024
#: Longest chain of cross-reference sections, and most objects.
LONGEST_CHAIN = 4096
MOST_OBJECTS = 10_000_000


class Ref(NamedTuple):
    number: int
    generation: int


class Name(str):
    """A name, as against a string (bytes)."""


@dataclass
class Stream:
    dict: dict[str, Any]
    raw: bytes


class Entry(NamedTuple):
    kind: str  # Free, InUse or Compressed
    offset: int = 0
    generation: int = 0
    container: int = 0
    index: int = 0


class _Tokens:
    """Tokens with a few of them looked at ahead."""

    def __init__(self, source: Iterator[Token]):
        self.source, self.ahead = source, []

    def peek(self, k: int = 0) -> Token | None:
        while len(self.ahead) <= k:
            self.ahead.append(next(self.source, None))
        return self.ahead[k]

    def take(self) -> Token | None:
        return self.ahead.pop(0) if self.ahead else next(self.source, None)


def _value(t: _Tokens, depth: int = 0) -> Any:
    token = t.take()
    if token is None or depth > 100:
        return None
    if token.type == "Integer":
        a, b = t.peek(), t.peek(1)
        if a and b and a.type == "Integer" and b.type == "Keyword" and b.value == b"R":
            t.take(), t.take()
            return Ref(token.int_val, a.int_val)
        return token.int_val
    if token.type == "Real":
        return token.float_val
    if token.type == "Name":
        return Name(name_text(token.value))
    if token.type in ("StringLit", "HexStr"):
        return string_bytes(token.value)
    if token.type == "ArrayStart":
        out = []
        while (n := t.peek()) and n.type != "ArrayEnd":
            if n.type in ("DictEnd", "StreamStart") or n.value == b"endobj":
                return out
            out.append(_value(t, depth + 1))
        t.take()
        return out
    if token.type == "DictStart":
        made: dict[str, Any] = {}
        while (n := t.peek()) and n.type != "DictEnd":
            if n.type == "StreamStart" or n.value == b"endobj":
                return made
            if n.type != "Name":
                t.take()
                continue
            key = name_text(t.take().value)
            made[key] = _value(t, depth + 1)
        t.take()
        return made
    return {b"true": True, b"false": False}.get(token.value)


_END = rb"(?=[\x00\t\n\f\r ()<>\[\]{}/%]|\Z)"
#: The tokens of which nearly all objects consist, in their plain form; a reference is one of them.
_PLAIN = re.compile(
    rb"[\x00\t\n\f\r ]*(?:/([A-Za-z0-9_.+:\-]*)" + _END + rb"|([0-9]{1,9})[\x00\t\n\f\r ]+([0-9]{1,9})[\x00\t\n\f\r ]+R" + _END + rb"|(-?[0-9]{1,15})" + _END
    + rb"|(-?[0-9]+\.[0-9]*)" + _END + rb"|(<<)|(>>)|(\[)|(\])|\(([^()\\\r]*)\)|(true|false|null)" + _END + rb")"
)
_NAME, _REF, _INTEGER, _REAL, _DICT, _DICT_END, _ARRAY, _ARRAY_END, _STRING, _WORD = 1, 3, 4, 5, 6, 7, 8, 9, 10, 11
_WORDS = {b"true": True, b"false": False, b"null": None}
_NEXT = re.compile(rb"[\x00\t\n\f\r ]*(stream|endobj)" + _END)


def _plain(data: bytes, at: int) -> tuple[Any, int] | None:
    """The object at ``at`` and where it ends; None where a token is not plain, which `_value` has to read."""
    match, above, inside, key = _PLAIN.match, [], None, None
    while True:
        m = match(data, at)
        if m is None:
            return None
        at, kind = m.end(), m.lastindex
        if kind == _NAME:
            value = Name(m[1].decode("latin-1"))
            if key is None and type(inside) is dict:
                key = str(value)
                continue
        elif kind == _DICT_END or kind == _ARRAY_END:
            if type(inside) is not (dict if kind == _DICT_END else list) or key is not None:
                return None
            value = inside
            inside, key = above.pop()
        elif key is None and type(inside) is dict:
            return None
        elif kind == _INTEGER:
            if inside is None:
                return None  # what follows may make a reference of it
            value = int(m[4])
        elif kind == _REF:
            value = Ref(int(m[2]), int(m[3]))
        elif kind == _STRING:
            value = m[10]
        elif kind == _REAL:
            value = single(float(m[5]))
        elif kind == _WORD:
            value = _WORDS[m[11]]
        else:
            if len(above) > 50:
                return None
            above.append((inside, key))
            inside, key = ({} if kind == _DICT else []), None
            continue
        if inside is None:
            return value, at
        if type(inside) is list:
            inside.append(value)
        else:
            inside[key] = value
            key = None


def parse(data: bytes, at: int = 0) -> Any:
    """The object that starts at ``at``."""
    if plain := _plain(data, at):
        return plain[0]
    return _value(_Tokens(tokens(data, at)))


_OBJECT = re.compile(rb"(?<![0-9])([0-9]{1,10})[\x00\t\n\f\r ]+([0-9]{1,5})[\x00\t\n\f\r ]+obj\b")
_START = re.compile(rb"startxref[\x00\t\n\f\r ]+([0-9]{1,20})")


@dataclass
class Trailer:
    startxref: int | None = None
    root: Ref | None = None
    prev: int | None = None


def locate_trailer(data: bytes, tail: int = TAIL) -> Trailer:
    """The last usable startxref in the file's tail, with the root and previous section of its dictionary."""
    at = _last_start(data, tail)
    if at is None:
        return Trailer()
    found = _section(data, at)
    said = found[1] if found else {}
    root, prev = said.get("Root"), said.get("Prev")
    return Trailer(at, root if isinstance(root, Ref) else None, prev if isinstance(prev, int) else None)


def _last_start(data: bytes, tail: int = TAIL) -> int | None:
    """Where the last usable startxref in the file's tail points to."""
    for m in reversed(list(_START.finditer(data, max(0, len(data) - tail)))):
        if (at := int(m[1])) < len(data):
            return at
    return None


def _predicted(data: bytes, parms: dict[str, Any]) -> bytes:
    """Undo PNG row predictors."""
    n = {k: v if isinstance(v := parms.get(k), int) and 0 < v < 1 << 20 else d for k, d in (("Predictor", 1), ("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1))}
    if n["Predictor"] < 10:
        return data
    step = max(1, n["Colors"] * n["BitsPerComponent"] // 8)
    width = n["Columns"] * step
    out, above = bytearray(), bytearray(width)
    for at in range(0, len(data) - width, width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        for i in range(width):
            a, b, c = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            if kind == 4:
                p = a + b - c
                add = min((a, b, c), key=lambda x: abs(p - x))
            else:
                add = (0, a, b, (a + b) // 2)[kind] if kind < 4 else 0
            row[i] = (row[i] + add) & 255
        out += row
        above = row
    return bytes(out)


def decoded(stream: Stream, resolve=lambda x: x) -> bytes:
    """A stream's data after its filters; an unknown filter ends the chain."""
    filters, parms = resolve(stream.dict.get("Filter")), resolve(stream.dict.get("DecodeParms"))
    filters = filters if isinstance(filters, list) else [filters] if filters else []
    parms = parms if isinstance(parms, list) else [parms] * len(filters)
    data = stream.raw
    for f, p in zip(filters, parms + [None] * len(filters), strict=False):
        name = resolve(f)
        if name in ("FlateDecode", "Fl"):
            engine = zlib.decompressobj()
            try:
                data = engine.decompress(data, LARGEST)
            except zlib.error:
                return b""
            p = resolve(p)
            data = _predicted(data, p if isinstance(p, dict) else {})
        elif name in ("ASCIIHexDecode", "AHx"):
            data = string_bytes(b"<" + data.split(b">")[0] + b">")
        else:
            return b""
    return data


def _stream_at(data: bytes, at: int, length: Any) -> bytes:
    """Payload after a stream keyword that ends at ``at``."""
    at += 2 if data[at : at + 2] == b"\r\n" else 1 if data[at : at + 1] in (b"\n", b"\r") else 0
    if isinstance(length, int) and 0 <= length <= len(data) - at and re.match(rb"[\x00\t\n\f\r ]*endstream", data[at + length : at + length + 20]):
        return data[at : at + length]
    end = data.find(b"endstream", at)
    return re.sub(rb"\r?\n\Z|\r\Z", b"", data[at:end]) if end >= 0 else data[at:]


def object_at(data: bytes, at: int, resolve=lambda x: x) -> tuple[Ref, Any] | None:
    """The indirect object at ``at``."""
    m = _OBJECT.match(data, at)
    if not m:
        return None
    if (plain := _plain(data, m.end())) and (after := _NEXT.match(data, plain[1])):
        value = plain[0]
        if after[1] == b"stream" and isinstance(value, dict):
            value = Stream(value, _stream_at(data, after.end(), resolve(value.get("Length"))))
        return Ref(int(m[1]), int(m[2])), value
    t = _Tokens(tokens(data, m.end()))
    value = _value(t)
    after = t.peek()
    if isinstance(value, dict) and after and after.type == "StreamStart":
        value = Stream(value, _stream_at(data, after.pos + len(after.value), resolve(value.get("Length"))))
    return Ref(int(m[1]), int(m[2])), value


_ROW = re.compile(rb"[\x00\t\n\f\r ]*([0-9]{1,20})[\x00\t\n\f\r ]+([0-9]{1,10})[\x00\t\n\f\r ]+([fn])")
_HEAD = re.compile(rb"[\x00\t\n\f\r ]*([0-9]{1,10})[\x00\t\n\f\r ]+([0-9]{1,10})(?=[\x00\t\n\f\r ])")
_XREF, _TRAILER = re.compile(rb"[\x00\t\n\f\r ]*xref"), re.compile(rb"[\x00\t\n\f\r ]*trailer")


def _section(data: bytes, at: int) -> tuple[dict[int, Entry], dict[str, Any]] | None:
    """One cross-reference section, as a table or a stream: its entries and its dictionary."""
    m = _XREF.match(data, at)
    if m:
        entries, at = {}, m.end()
        while head := _HEAD.match(data, at):
            at, first, n = head.end(), int(head[1]), int(head[2])
            for k in range(min(n, MOST_OBJECTS)):
                row = _ROW.match(data, at)
                if not row:
                    return None
                at = row.end()
                entries[first + k] = Entry("InUse" if row[3] == b"n" else "Free", int(row[1]), int(row[2]))
        m = _TRAILER.match(data, at)
        said = parse(data, m.end()) if m else None
        return (entries, said) if isinstance(said, dict) else None
    found = object_at(data, at)
    if not found or not isinstance(found[1], Stream) or found[1].dict.get("Type") != "XRef":
        return None
    said, rows = found[1].dict, decoded(found[1])
    widths = said.get("W")
    if not (isinstance(widths, list) and len(widths) == 3 and all(isinstance(w, int) and 0 <= w <= 8 for w in widths)):
        return None
    index = said.get("Index") or [0, said.get("Size", 0)]
    if not (isinstance(index, list) and all(isinstance(x, int) and x >= 0 for x in index)):
        return None
    entries, at, size = {}, 0, sum(widths)
    for first, n in zip(index[::2], index[1::2], strict=False):
        for number in range(first, first + min(n, MOST_OBJECTS)):
            row = rows[at : at + size]
            if size == 0 or len(row) < size:
                break
            at += size
            edges = [0, widths[0], widths[0] + widths[1], size]
            kind, x, y = (int.from_bytes(row[a:b], "big") if b > a else None for a, b in zip(edges, edges[1:], strict=False))
            kind = 1 if kind is None else kind
            if kind == 1:
                entries[number] = Entry("InUse", x or 0, y or 0)
            elif kind == 2:
                entries[number] = Entry("Compressed", container=x or 0, index=y or 0)
            elif kind == 0:
                entries[number] = Entry("Free", x or 0, y or 0)
    return entries, said


@dataclass
class XRef:
    entries: dict[int, Entry] = field(default_factory=dict)
    trailer: dict[str, Any] = field(default_factory=dict)
    rebuilt: bool = False


def read_xref(data: bytes) -> XRef:
    """All cross-references; newer sections win. Where the chain is broken, objects are found by looking for them."""
    out, at, seen = XRef(), _last_start(data), set()
    while at is not None and at not in seen and len(seen) < LONGEST_CHAIN:
        seen.add(at)
        found = _section(data, at)
        if not found:
            break
        entries, said = found
        hybrid = said.get("XRefStm")
        more = _section(data, hybrid) if isinstance(hybrid, int) and hybrid not in seen else None
        for source in (entries, more[0] if more else {}):
            for number, entry in source.items():
                if number not in out.entries or (source is not entries and out.entries[number].kind == "Free"):
                    out.entries[number] = entry
        out.trailer = {**said, **out.trailer}
        at = said.get("Prev") if isinstance(said.get("Prev"), int) and 0 <= said["Prev"] < len(data) else None
    if not out.entries or not isinstance(out.trailer.get("Root"), Ref):
        out.rebuilt = True
        for m in _OBJECT.finditer(data):
            out.entries[int(m[1])] = Entry("InUse", m.start(), int(m[2]))
        for m in re.finditer(rb"trailer", data):
            said = parse(data, m.end())
            if isinstance(said, dict):
                out.trailer = {**out.trailer, **said}
    return out
