"""One page's glyphs as a single binary record of columns."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"UPS1"
_HEADER = struct.Struct("<4sIIIff" + "I" * 7 + "I8x")
_CRC_AT = 52
_KINDS = ("<f4", "<f4", "<f4", "<f4", "<u4", "<u8")


def _checksum(data: bytes) -> int:
    """CRC-32 of all but its own field."""
    return zlib.crc32(data[_CRC_AT + 4 :], zlib.crc32(data[:_CRC_AT]))


def build(page: int, width: float, height: float, columns: dict[str, list], postings: bytes = b"") -> bytes:
    """``columns``: x, y, w, h, codepoints of equal length and term_hashes, which are sorted."""
    glyphs = [np.asarray(columns[c], k) for c, k in zip(("x", "y", "w", "h", "codepoints"), _KINDS, strict=False)]
    if len({len(g) for g in glyphs}) > 1:
        raise ValueError("glyph columns differ in length")
    parts = [g.tobytes() for g in glyphs] + [np.sort(np.asarray(columns["term_hashes"], "<u8")).tobytes(), postings]
    offsets, body, at = [], b"", _HEADER.size
    for p in parts:
        pad = -at % 32
        offsets.append(at + pad)
        body += bytes(pad) + p
        at += pad + len(p)
    head = _HEADER.pack(MAGIC, page, len(glyphs[0]), len(columns["term_hashes"]), width, height, *offsets, 0)
    crc = _checksum(head + body)
    return _HEADER.pack(MAGIC, page, len(glyphs[0]), len(columns["term_hashes"]), width, height, *offsets, crc) + body


def read(data: bytes) -> dict | None:
    """The record's columns; null for data that is not a sound record."""
    if len(data) < _HEADER.size:
        return None
    magic, page, glyphs, terms, width, height, *offsets, crc = _HEADER.unpack_from(data)
    sizes = [4 * glyphs] * 5 + [8 * terms]
    ends = [o + s for o, s in zip(offsets, sizes, strict=False)]
    ordered = all(o % 32 == 0 for o in offsets) and all(e <= o for e, o in zip([_HEADER.size, *ends], offsets, strict=True))
    if magic != MAGIC or not ordered or offsets[-1] > len(data) or crc != _checksum(data):
        return None
    names = ("x", "y", "w", "h", "codepoints", "term_hashes")
    out = {n: np.frombuffer(data, k, s // int(k[2]), o).tolist() for n, k, s, o in zip(names, _KINDS, sizes, offsets, strict=False)}
    if out["term_hashes"] != sorted(out["term_hashes"]):
        return None
    return out | {"page": page, "width": width, "height": height, "postings": data[offsets[-1] :]}
