"""Fill-in-the-middle samples by run-length class encoding.

A text's characters fall into classes by the bytes that UTF-8 takes for them. Its maximal runs of one class are kept with
the characters and the bytes before them; the byte offset of a cut after any number of characters then takes a binary
search for the run that holds it and one multiplication. A text of one class is one run, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are cut at all, and of those cut so many get the suffix first.
CUT, SUFFIX_FIRST = 90, 20
#: An output batch ends once it holds so many bytes.
BATCH_BYTES = 8_000_000

#: UTF-8 bytes of a character by its first byte.
_WIDTH = np.repeat(np.array([1, 2, 3, 4], np.uint8), [0xC0, 0x20, 0x10, 0x10])


class Runs:
    """Maximal runs of characters of one UTF-8 width: characters and bytes before each, its width, and both totals."""

    def __init__(self, data: bytes):
        if data.isascii():
            self.chars, self.bytes, self.width = np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64)
            self.n = len(data)
            return
        raw = np.frombuffer(data, np.uint8)
        width = _WIDTH[raw[(raw & 0xC0) != 0x80]]
        self.n = len(width)
        self.chars = np.concatenate([[0], np.flatnonzero(width[1:] != width[:-1]) + 1]).astype(np.int64)
        self.width = width[self.chars].astype(np.int64)
        lengths = np.diff(self.chars, append=self.n) * self.width
        self.bytes = np.cumsum(lengths) - lengths

    def offset(self, chars: int) -> int:
        """The bytes before the character that ``chars`` characters precede (or before the end)."""
        run = int(np.searchsorted(self.chars, chars, "right")) - 1
        return int(self.bytes[run] + (chars - self.chars[run]) * self.width[run])


def draws(doc_id: Column | str, seed: int = 1) -> list[Column]:
    """Four numbers below 2**32 that depend on the id alone: groups of the hex sha256 of ``seed:id`` (null id: empty)."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    said = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(said, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def class_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The runs as a table: doc_id, n (characters), chars and bytes (before each run), width; a null text has no characters."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [Runs((x.as_py() or "").encode()) for x in batch.column(1)]
            columns = [batch.column(0), pa.array([r.n for r in found], pa.int64())]
            columns += [pa.array([getattr(r, name).tolist() for r in found], pa.list_(pa.int64())) for name in ("chars", "bytes", "width")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "chars", "bytes", "width"])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"doc_id {kind}, n long, chars array<long>, bytes array<long>, width array<long>")


def fill_in_middle(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    seed: int = 1,
    cut: int = CUT,
    suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """Cut every text into prefix, middle and suffix at two places drawn from its id, and write them in their new order.

    One row a document: doc_id, n (characters), form (``plain``, ``psm`` or ``spm``), prefix_chars and middle_chars
    (null if plain), output. A null or empty text is plain and empty, a text that holds one of the three marks stays
    plain; equal ids give equal draws, so repeated rows come out alike; a null id draws as an empty one. Other columns
    are not read, an empty table gives no rows, a text of any length is cut as a whole.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    marks = p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

        for batch in batches:
            first, size, rows = 0, 0, []

            def whole(first: int, rows: list, ids: pa.Array = batch.column(0)) -> pa.RecordBatch:
                *plain, output = [list(c) for c in zip(*rows, strict=True)]
                columns = [pa.array(c, t) for c, t in zip(plain, types, strict=False)]
                # the pieces are whole characters, so their bytes are a string as they are
                return pa.RecordBatch.from_arrays([ids.slice(first, len(rows)), *columns, pa.array(output, pa.binary()).cast(pa.string())], names)

            for i in range(batch.num_rows):
                buffer = batch.column(1)[i].as_buffer()
                data = buffer.to_pybytes() if buffer is not None else b""
                h1, h2, h3, h4 = (batch.column(2 + k)[i].as_py() for k in range(4))
                runs = Runs(data)
                if not data or h3 % 100 >= cut or any(x in data for x in marks):
                    rows.append((runs.n, "plain", None, None, data))
                else:
                    a, b = sorted((h1 % (runs.n + 1), h2 % (runs.n + 1)))
                    x, y = runs.offset(a), runs.offset(b)
                    form = "spm" if h4 % 100 < suffix_first else "psm"
                    parts = (p, data[:x], s, data[y:], m, data[x:y]) if form == "psm" else (s, data[y:], p, data[:x], m, data[x:y])
                    rows.append((runs.n, form, a, b - a, b"".join(parts)))
                size += len(data)
                if size >= BATCH_BYTES:
                    yield whole(first, rows)
                    first, size, rows = i + 1, 0, []
            if rows:
                yield whole(first, rows)

    drawn = [h.alias(f"h{i}") for i, h in enumerate(draws(doc_id, seed))]
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select(F.col(doc_id), F.col(text), *drawn).mapInArrow(run, schema)


def restored(output: Column | str, form: Column | str) -> Column:
    """The text that ``fill_in_middle`` was given, by its output and form alone; no text that was cut holds a mark."""
    out, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    between = lambda a, b: F.substring_index(F.substring_index(out, a, -1), b, 1)
    middle = F.substring_index(out, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(out)
