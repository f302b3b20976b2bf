"""Character maps from codes to Unicode."""

from __future__ import annotations

from dataclasses import dataclass, field

from folioscope.decode.lexer import Token, string_bytes, tokens
from folioscope.functions.payloads import LIGATURES

#: Fixed value: most code points for one code.
LONGEST = 64


@dataclass
class CMap:
    map: dict[int, str] = field(default_factory=dict)
    code_bytes: int = 1
    skipped: int = 0


def utf16(data: bytes) -> str | None:
    """UTF-16 (big-endian) with ligatures spelled out; null for broken data."""
    if not data or len(data) % 2:
        return None
    try:
        text = data.decode("utf-16-be")
    except UnicodeDecodeError:
        return None
    text = "".join(LIGATURES.get(c, c) for c in text)
    return text if len(text) <= LONGEST else None


def parse_cmap(data: bytes) -> CMap:
    """All bfchar and bfrange entries; a later definition of a code wins."""
    out, stack, bracket, inside = CMap(), [], None, None

    def put(code: bytes, text: str | None) -> None:
        if text is None or not 1 <= len(code) <= 4:
            out.skipped += 1
        else:
            out.map[int.from_bytes(code, "big")] = text

    def span(first: bytes, last: bytes, to: bytes | list[bytes]) -> None:
        a, b = int.from_bytes(first, "big"), int.from_bytes(last, "big")
        if len(first) != len(last) or b < a or b - a > 0xFFFF:
            out.skipped += 1
            return
        for k in range(b - a + 1):
            code = (a + k).to_bytes(len(first), "big")
            if isinstance(to, list):
                if k < len(to):
                    put(code, utf16(to[k]))
            else:
                low = int.from_bytes(to[-2:], "big") + k
                put(code, utf16(to[:-2] + low.to_bytes(2, "big")) if len(to) >= 2 and low <= 0xFFFF else None)

    def text(t: Token) -> bytes:
        return string_bytes(t.value)

    for t in tokens(data):
        if t.type == "Keyword":
            word = t.value.decode("latin-1")
            if word.startswith("begin"):
                inside, stack, bracket = word[5:], [], None
            elif word.startswith("end"):
                inside = None
        elif inside == "codespacerange" and t.type == "HexStr":
            out.code_bytes = max(1, len(text(t)))
        elif inside in ("bfchar", "bfrange"):
            if t.type == "ArrayStart":
                bracket = []
            elif t.type == "ArrayEnd" and bracket is not None:
                stack.append(bracket)
                bracket = None
            elif t.type == "HexStr":
                (stack if bracket is None else bracket).append(text(t))
            if inside == "bfchar" and len(stack) == 2:
                put(stack[0], utf16(stack[1]))
                stack = []
            elif inside == "bfrange" and len(stack) == 3:
                span(*stack)
                stack = []
    return out
