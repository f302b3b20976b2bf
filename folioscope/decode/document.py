"""Paged documents from bytes and back: page tree, text, links, and a writer of selected pages."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

from folioscope.decode.cmap import CMap, parse_cmap
from folioscope.decode.glyphs import Interpreter
from folioscope.decode.objects import Name, Ref, Stream, decoded, object_at, parse, read_xref
from folioscope.errors import UnreadableError

#: Attributes that pages take over from the nodes above them.
INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate")


class Document:
    """A document's objects, resolved as they are asked for. Encrypted, pageless or broken data is unreadable."""

    def __init__(self, data: bytes):
        self.data, self.cache, self.members, self.maps = data, {}, {}, {}
        if b"%PDF-" not in data[:1024]:
            raise UnreadableError("not a document")
        self.xref = read_xref(data)
        if "Encrypt" in self.xref.trailer:
            raise UnreadableError("document is encrypted")
        root = self.get(self.xref.trailer.get("Root"))
        if not isinstance(root, dict):
            root = next((x for x in map(self.get, [Ref(n, 0) for n in self.xref.entries]) if isinstance(x, dict) and x.get("Type") == "Catalog"), None)
        if not isinstance(root, dict):
            raise UnreadableError("document has no catalog")
        self.pages = list(self._pages(root.get("Pages"), {}, set()))
        if not self.pages:
            raise UnreadableError("document has no pages")

    @property
    def page_count(self) -> int:
        return len(self.pages)

    def get(self, value: Any) -> Any:
        """The object that a reference names, anything else as it is."""
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            if value.number not in self.cache:
                self.cache[value.number] = None
                self.cache[value.number] = self._load(value)
            value = self.cache[value.number]
        return None

    def dict_of(self, value: Any) -> dict[str, Any]:
        """A dictionary, or an empty one in its place."""
        found = self.get(value)
        found = found.dict if isinstance(found, Stream) else found
        return found if isinstance(found, dict) else {}

    def list_of(self, value: Any) -> list[Any]:
        found = self.get(value)
        return found if isinstance(found, list) else []

    def number(self, value: Any, default: float) -> float:
        found = self.get(value)
        return found if isinstance(found, (int, float)) and not isinstance(found, bool) else default

    def _load(self, ref: Ref) -> Any:
        entry = self.xref.entries.get(ref.number)
        if entry is None or entry.kind == "Free":
            return None
        if entry.kind == "InUse":
            found = object_at(self.data, entry.offset, self.get)
            return found[1] if found and found[0].number == ref.number else None
        return self._members(entry.container).get(ref.number)

    def _members(self, container: int) -> dict[int, Any]:
        if container not in self.members:
            stream, out = self.get(Ref(container, 0)), {}
            if isinstance(stream, Stream):
                data, first = decoded(stream, self.get), int(self.number(stream.dict.get("First"), 0))
                head = [int(x) for x in data[:first].split() if x.isdigit()]
                for number, offset in zip(head[::2], head[1::2], strict=False):
                    out[number] = parse(data, first + offset)
            self.members[container] = out
        return self.members[container]

    def _pages(self, node: Any, above: dict[str, Any], seen: set[int]) -> Iterator[dict[str, Any]]:
        number = node.number if isinstance(node, Ref) else None
        found = self.get(node)
        if not isinstance(found, dict) or number in seen:
            return
        if number is not None:
            seen.add(number)
        here = above | {k: found[k] for k in INHERITED if k in found}
        kids = self.get(found.get("Kids"))
        if isinstance(kids, list):
            for kid in kids:
                yield from self._pages(kid, here, seen)
        elif found.get("Type") == "Page" or "Contents" in found:
            yield here | found

    def content(self, page: int) -> bytes:
        found = self.get(self.pages[page].get("Contents"))
        streams = [self.get(x) for x in found] if isinstance(found, list) else [found]
        return b"\n".join(decoded(s, self.get) for s in streams if isinstance(s, Stream))

    def cmap(self, payload: bytes) -> CMap:
        """The character map of a payload, parsed once for all fonts and pages that have it."""
        if payload not in self.maps:
            self.maps[payload] = parse_cmap(payload)
        return self.maps[payload]

    def fonts(self, page: int) -> dict[str, tuple[CMap | None, dict[int, float], float, int]]:
        """By resource name: map to Unicode, widths, default width, bytes of a code."""
        resources = self.dict_of(self.pages[page].get("Resources"))
        out = {}
        for name, ref in self.dict_of(resources.get("Font")).items():
            font = self.dict_of(ref)
            to = self.get(font.get("ToUnicode"))
            cmap = self.cmap(decoded(to, self.get)) if isinstance(to, Stream) else None
            wide = self.get(font.get("Subtype")) == "Type0"
            first = int(self.number(font.get("FirstChar"), 0))
            widths = {first + i: self.number(w, 0) for i, w in enumerate(self.list_of(font.get("Widths")))}
            below = self.dict_of(next(iter(self.list_of(font.get("DescendantFonts"))), None))
            if wide:
                widths = _cid_widths([self.get(x) for x in self.list_of(below.get("W"))])
            default = self.number(below.get("DW"), 1000) if wide else 500
            out[name] = (cmap, widths, default, 2 if wide else 1)
        return out

    def text(self, page: int) -> str:
        """Text in the order it is shown: a new line where the baseline moves, a space over a gap."""
        fonts = self.fonts(page)
        none = (None, {}, 500, 1)

        def width(name: str, code: int) -> float:
            _, widths, default, _ = fonts.get(name, none)
            return widths.get(code, default)

        out: list[str] = []
        last = None
        for g in Interpreter(width, lambda f: fonts.get(f, none)[3]).run(self.content(page)):
            cmap, _, _, size = fonts.get(g.font, none)
            letter = cmap.map.get(g.code, "") if cmap else chr(g.code) if size == 1 else ""
            x, y, em = g.trm[4], g.trm[5], abs(g.trm[0]) or abs(g.trm[3]) or 1.0
            if last is not None:
                if abs(y - last[1]) > 0.3 * em:
                    out.append("\n")
                elif x - last[0] > 0.2 * em and out and not out[-1].endswith(" "):
                    out.append(" ")
            out.append(letter)
            last = (x + g.advance * (g.trm[0] / em if em else 1.0), y)
        return "".join(out)

    def links(self, page: int) -> list[tuple[str, list[float]]]:
        """(address, rectangle) of annotations with an address; a missing rectangle is zeros."""
        out = []
        for ref in self.list_of(self.pages[page].get("Annots")):
            note = self.dict_of(ref)
            uri = self.get(self.dict_of(note.get("A")).get("URI"))
            if isinstance(uri, (bytes, str)) and uri:
                rect = [self.number(x, 0.0) for x in self.list_of(note.get("Rect"))]
                out.append((uri.decode("latin-1") if isinstance(uri, bytes) else uri, [float(x) for x in rect] if len(rect) == 4 else [0.0] * 4))
        return out


def _cid_widths(w: list[Any]) -> dict[int, float]:
    """Widths from a list of either `first [w ...]` or `first last w`."""
    out, at = {}, 0
    while at + 1 < len(w) and isinstance(w[at], int):
        if isinstance(w[at + 1], list):
            out |= {w[at] + i: x for i, x in enumerate(w[at + 1]) if isinstance(x, (int, float))}
            at += 2
        elif at + 2 < len(w) and isinstance(w[at + 1], int) and isinstance(w[at + 2], (int, float)):
            out |= dict.fromkeys(range(w[at], min(w[at + 1], w[at] + 65535) + 1), w[at + 2])
            at += 3
        else:
            break
    return out


class Writer:
    """A new document from pages of others; objects shared by pages of one source are written once."""

    def __init__(self) -> None:
        self.objects: list[bytes] = [b"", b""]  # catalog and page tree, known at the end
        self.kids: list[int] = []
        self.copies: dict[tuple[int, int], int] = {}

    def add(self, doc: Document, page: int) -> None:
        found = {k: v for k, v in doc.pages[page].items() if k not in ("Parent", "B", "StructParents")}
        found["Parent"] = Ref(2, 0)
        self.objects.append(b"")
        number = len(self.objects)
        self.kids.append(number)
        self.objects[number - 1] = self._bytes(found, doc, 0, own=("Parent",))

    def _copy(self, doc: Document, ref: Ref) -> int | None:
        key = (id(doc), ref.number)
        if key not in self.copies:
            value = doc.get(ref)
            if isinstance(value, dict) and value.get("Type") in ("Page", "Pages", "Catalog"):
                return None  # links to other pages are not followed
            self.objects.append(b"")
            self.copies[key] = len(self.objects)
            self.objects[self.copies[key] - 1] = self._bytes(value, doc, 0)
        return self.copies[key]

    def _bytes(self, v: Any, doc: Document, depth: int, own: tuple[str, ...] = ()) -> bytes:
        if depth > 100:
            return b"null"
        if isinstance(v, Ref):
            number = self._copy(doc, v)
            return b"null" if number is None else b"%d 0 R" % number
        if isinstance(v, Stream):
            said = {k: x for k, x in v.dict.items() if k != "Length"} | {"Length": len(v.raw)}
            return self._bytes(said, doc, depth + 1) + b"\nstream\n" + v.raw + b"\nendstream"
        if isinstance(v, dict):
            parts = (_name(k) + b" " + (b"%d 0 R" % x.number if k in own else self._bytes(x, doc, depth + 1)) for k, x in v.items())
            return b"<<" + b" ".join(parts) + b">>"
        if isinstance(v, list):
            return b"[" + b" ".join(self._bytes(x, doc, depth + 1) for x in v) + b"]"
        if isinstance(v, bool):
            return b"true" if v else b"false"
        if isinstance(v, Name):
            return _name(v)
        if isinstance(v, bytes):
            return b"<" + v.hex().encode() + b">"
        if isinstance(v, (int, float)):
            return repr(v).encode() if isinstance(v, int) else (b"%.9f" % v).rstrip(b"0").rstrip(b".")
        return b"null"

    def data(self) -> bytes:
        self.objects[0] = b"<</Type /Catalog /Pages 2 0 R>>"
        self.objects[1] = b"<</Type /Pages /Count %d /Kids [%s]>>" % (len(self.kids), b" ".join(b"%d 0 R" % k for k in self.kids))
        out, offsets = bytearray(b"%PDF-1.7\n"), []
        for i, body in enumerate(self.objects, 1):
            offsets.append(len(out))
            out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
        start = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(offsets) + 1) + b"".join(b"%010d 00000 n \n" % o for o in offsets)
        return bytes(out + b"trailer\n<</Size %d /Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(offsets) + 1, start))


def _name(text: str) -> bytes:
    raw = text.encode("latin-1", "replace")
    return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"()<>[]{}/%#" else b"#%02x" % c for c in raw)


def assemble(parts: Iterable[tuple[bytes, list[int] | None]]) -> tuple[bytes, list[int]]:
    """A document of (data, 0-based pages; None for all) parts in order, and the pages taken from each."""
    writer, counts, kept = Writer(), [], []
    for data, pages in parts:
        doc = Document(data)
        kept.append(doc)  # copies are told apart by their documents, which have to stay
        chosen = range(doc.page_count) if pages is None else pages
        for p in chosen:
            writer.add(doc, p)
        counts.append(len(chosen))
    return writer.data(), counts


def from_texts(texts: list[str], links: dict[int, list[tuple[str, list[float]]]] | None = None) -> bytes:
    """A plain document with one page for each text, one line below the other."""
    objects: list[bytes] = [b"<</Type /Catalog /Pages 2 0 R>>", b"", b"<</Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding>>"]
    kids = []
    for i, text in enumerate(texts):
        shown = b" T* ".join(b"(" + line.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj" for line in text.split("\n"))
        body = b"BT /F1 12 Tf 14 TL 72 720 Td " + shown + b" ET"
        objects.append(b"<</Length %d>>\nstream\n%s\nendstream" % (len(body), body))
        notes = b" ".join(
            b"<</Type /Annot /Subtype /Link /Rect [%s] /A <</S /URI /URI (%s)>>>>" % (b" ".join(b"%g" % x for x in rect), uri.encode())
            for uri, rect in (links or {}).get(i, [])
        )
        objects.append(b"<</Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources <</Font <</F1 3 0 R>>>> /Contents %d 0 R /Annots [%s]>>" % (len(objects), notes))
        kids.append(len(objects))
    objects[1] = b"<</Type /Pages /Count %d /Kids [%s]>>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    w = Writer()
    w.objects, w.kids = objects, kids
    return w.data()
