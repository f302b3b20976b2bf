"""Glyph placements of content streams: the text-positioning operators, run in order.

Arithmetic is in double precision; operands and results are rounded to 32 bits once.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from folioscope.decode.lexer import Token, single, string_bytes, tokens

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: Operands and saved states that are kept.
MOST_OPERANDS, MOST_STATES = 8, 64
Matrix = tuple[float, ...]


class Glyph(NamedTuple):
    code: int
    font: str
    trm: tuple[float, ...]
    advance: float


_THREE = struct.Struct("<fff")


def _singles(x: float, y: float, z: float) -> tuple[float, float, float]:
    try:
        return _THREE.unpack(_THREE.pack(x, y, z))
    except OverflowError:
        return single(x), single(y), single(z)


def times(m: Matrix, n: Matrix) -> Matrix:
    """The matrix that applies ``m``, then ``n``."""
    a, b, c, d, e, f = m
    return (a * n[0] + b * n[2], a * n[1] + b * n[3], c * n[0] + d * n[2], c * n[1] + d * n[3], e * n[0] + f * n[2] + n[4], e * n[1] + f * n[3] + n[5])


@dataclass(frozen=True)
class TextState:
    char_spacing: float = 0.0
    word_spacing: float = 0.0
    scale: float = 100.0
    leading: float = 0.0
    size: float = 0.0
    rise: float = 0.0
    mode: int = 0
    font: str = ""


#: Operators that set one number of the text state.
_SETTERS = {b"Tc": "char_spacing", b"Tw": "word_spacing", b"Tz": "scale", b"TL": "leading", b"Ts": "rise"}
#: What an interpreter counts, all from zero.
COUNTERS = (
    "ops_dispatched", "ops_unknown", "ops_outside_text", "operand_overflows", "strings_shown", "glyphs_emitted", "tj_arrays_replayed", "tj_number_adjustments",
    "unterminated_code_tail", "gstate_overflow", "gstate_underflow", "stray_array_ends", "stray_dict_ends", "stray_stream_tokens",
)
_IN_TEXT = {b"Tj", b"TJ", b"Td", b"TD", b"Tm", b"T*", b"'", b'"'}


@dataclass
class Interpreter:
    """``width(font, code)`` in thousandths and ``code_bytes(font)`` stand in for font programs."""

    width: Callable[[str, int], float] = lambda font, code: 1000
    code_bytes: Callable[[str], int] = lambda font: 1
    ctm: Matrix = IDENTITY
    line: Matrix = IDENTITY
    text: TextState = TextState()
    in_text: bool = False
    moved: float = 0.0
    saved: list[tuple[Matrix, TextState]] = field(default_factory=list)
    stats: Counter = field(default_factory=Counter)

    def run(self, content: bytes) -> Iterator[Glyph]:
        """Glyphs of a content stream; state carries over to the next one."""
        numbers: list[float] = []
        name: str | None = None
        string: bytes | None = None
        array: list[Token] | None = None
        brackets = braces = 0
        for t in tokens(content):
            if t.type in ("DictStart", "DictEnd") and not brackets:
                if t.type == "DictStart":
                    braces += 1
                elif braces:
                    braces -= 1
                else:
                    self.stats["stray_dict_ends"] += 1
            elif braces:
                continue
            elif t.type == "ArrayStart":
                if not brackets:
                    array = []
                brackets += 1
            elif t.type == "ArrayEnd":
                if brackets:
                    brackets -= 1
                else:
                    self.stats["stray_array_ends"] += 1
            elif brackets:
                if brackets == 1:
                    array.append(t)
            elif t.type in ("Integer", "Real"):
                if len(numbers) < MOST_OPERANDS:
                    numbers.append(t.number)
                else:
                    self.stats["operand_overflows"] += 1
            elif t.type == "Name":
                if name is None:
                    name = t.value[1:].decode("latin-1")
                else:
                    self.stats["operand_overflows"] += 1
            elif t.type in ("StringLit", "HexStr"):
                if string is None:
                    string = string_bytes(t.value)
                else:
                    self.stats["operand_overflows"] += 1
            else:
                if t.type == "Keyword":
                    self.stats["ops_dispatched"] += 1
                    yield from self._do(t.value, numbers, name, string, array)
                else:
                    self.stats["stray_stream_tokens"] += 1
                numbers, name, string, array = [], None, None, None

    def _do(self, op: bytes, n: list[float], name: str | None, string: bytes | None, array: list[Token] | None) -> Iterable[Glyph]:
        if op in _IN_TEXT:
            if not self.in_text:
                self.stats["ops_outside_text"] += 1
            else:
                return self._in_text(op, n, string, array)
        elif op in _SETTERS:
            if n:
                self.text = replace(self.text, **{_SETTERS[op]: single(n[0])})
        elif op == b"Tf":
            if name is not None and n:
                self.text = replace(self.text, font=name, size=single(n[0]))
        elif op == b"Tr":
            if n:
                self.text = replace(self.text, mode=int(n[0]))
        elif op == b"BT":
            self.in_text = True
            self._place(IDENTITY)
        elif op == b"ET":
            self.in_text = False
        elif op == b"q":
            if len(self.saved) < MOST_STATES:
                self.saved.append((self.ctm, self.text))
            else:
                self.stats["gstate_overflow"] += 1
        elif op == b"Q":
            if self.saved:
                self.ctm, self.text = self.saved.pop()
            else:
                self.stats["gstate_underflow"] += 1
        elif op == b"cm":
            if len(n) >= 6:
                self.ctm = times(tuple(n[:6]), self.ctm)
        else:
            self.stats["ops_unknown"] += 1
        return ()

    def _in_text(self, op: bytes, n: list[float], string: bytes | None, array: list[Token] | None) -> Iterable[Glyph]:
        if op in (b"Td", b"TD"):
            if len(n) >= 2:
                if op == b"TD":
                    self.text = replace(self.text, leading=single(-n[1]))
                self._move(n[0], n[1])
        elif op == b"Tm":
            if len(n) >= 6:
                self._place(tuple(n[:6]))
        elif op == b"T*":
            self._move(0.0, -self.text.leading)
        elif op == b"TJ":
            if array is not None:
                return self._adjusted(array)
        elif string is not None:
            if op == b'"':
                if len(n) < 2:
                    return ()
                self.text = replace(self.text, word_spacing=single(n[0]), char_spacing=single(n[1]))
            if op != b"Tj":
                self._move(0.0, -self.text.leading)
            return self._show(string)
        return ()

    def _place(self, m: Matrix) -> None:
        self.line, self.moved = m, 0.0

    def _move(self, x: float, y: float) -> None:
        self._place(times((1.0, 0.0, 0.0, 1.0, x, y), self.line))

    def _adjusted(self, array: list[Token]) -> Iterator[Glyph]:
        self.stats["tj_arrays_replayed"] += 1
        for t in array:
            if t.type in ("Integer", "Real"):
                self.moved -= t.number / 1000 * self.text.size * self.text.scale / 100
                self.stats["tj_number_adjustments"] += 1
            elif t.type in ("StringLit", "HexStr"):
                yield from self._show(string_bytes(t.value))

    def _show(self, data: bytes) -> list[Glyph]:
        self.stats["strings_shown"] += 1
        s, m, k = self.text, times(self.line, self.ctm), max(1, self.code_bytes(self.text.font))
        across, up, font, width, moved, out = s.size * s.scale / 100, s.size, s.font, self.width, self.moved, []
        a, b, c, d = map(single, (across * m[0], across * m[1], up * m[2], up * m[3]))
        m0, m1, x0, x1, y0, y1 = m[0], m[1], s.rise * m[2], m[4], s.rise * m[3], m[5]
        for at in range(0, len(data) - len(data) % k, k):
            code = data[at] if k == 1 else int.from_bytes(data[at : at + k], "big")
            step = width(font, code) / 1000 * across + s.char_spacing + (s.word_spacing if k == 1 and code == 32 else 0.0)
            x, y, advance = _singles(moved * m0 + x0 + x1, moved * m1 + y0 + y1, step)
            out.append(Glyph(code, font, (a, b, c, d, x, y), advance))
            moved += step
        self.moved = moved
        self.stats["glyphs_emitted"] += len(out)
        self.stats["unterminated_code_tail"] += len(data) % k
        return out
