"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items. A shift table over blocks of two words tells how far the search may
jump; where the shift is none, the windows that end in the block are selected by their hashed suffix and their hashed
first block, and compared with the document word for word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import table
from folioscope.llm.shingles import runs_of_many

WINDOW = 10
BLOCK = 2
#: Bytes of benchmark text searched for in one pass over the documents; more items take more passes.
PASS_BYTES = 16_000_000
_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of ASCII digits, ASCII letters (lower-cased) and any characters beyond ASCII."""
    return text.encode().translate(_TABLE).split() if text else []


class WuManber:
    """Occurrences of word windows, each with the items it stems from. Tables are arrays: about 50 bytes a window."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        known: dict[bytes, bytes] = {}
        self.names = [name for name, _ in items]
        self.words = [[known.setdefault(w, w) for w in words(text)] for _, text in items]
        lengths = np.array([min(window, len(w)) for w in self.words], np.int64)
        #: (length, block, blocks sorted, shift of each, suffixes sorted, first block, item and start of each window)
        self.tables = []
        for length in sorted({int(n) for n in lengths if n}):
            which = np.flatnonzero(lengths == length)
            texts = [self.words[i] for i in which]
            size = min(BLOCK, length)
            ((hashes, at),) = runs_of_many(texts, (size,))
            n = np.array([len(t) for t in texts])
            of = np.repeat(np.arange(len(texts)), n)[at]
            place = at - (np.cumsum(n) - n)[of]
            # a block that ends k words before the end of some window allows a shift of k; ends of windows allow none
            shift = np.maximum(length - size - place, 0).astype(np.uint8 if length < 256 else np.int32)
            order = np.lexsort((shift, hashes))
            first = np.flatnonzero(np.r_[True, np.diff(hashes[order]) != 0])
            start = np.flatnonzero(place <= n[of] - length)
            end = start + length - size
            suffix = np.argsort(hashes[end], kind="stable")
            windows = (hashes[end][suffix], hashes[start][suffix], which[of[start]][suffix].astype(np.int32), place[start][suffix].astype(np.int32))
            self.tables.append((length, size, hashes[order][first], shift[order][first], *windows))

    def size(self) -> int:
        """Bytes of the tables and of the references to words."""
        return sum(x.nbytes for t in self.tables for x in t[2:]) + 8 * sum(map(len, self.words))

    def search(self, w: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(start, end, item) of every occurrence of a window."""
        for length, size, blocks, shifts, suffixes, firsts, items, starts in self.tables:
            if len(w) < length:
                continue
            ((hashes, _),) = runs_of_many([w], (size,))
            at = np.searchsorted(blocks, hashes)
            at[at == len(blocks)] = 0
            by = np.where(blocks[at] == hashes, shifts[at], length - size + 1).tolist()
            place, last = length - size, len(by)
            while place < last:
                if by[place]:
                    place += by[place]
                    continue
                start = place + size - length
                low, high = np.searchsorted(suffixes, hashes[place], "left"), np.searchsorted(suffixes, hashes[place], "right")
                for k in low + np.flatnonzero(firsts[low:high] == hashes[start]):
                    if self.words[items[k]][starts[k] : starts[k] + length] == w[start : start + length]:
                        yield start, start + length, int(items[k])
                place += 1


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """``docs`` with n_words, hits (merged spans of words, end exclusive), items (ids as strings, sorted), contaminated.

    Null and empty texts have no words; items without words occur nowhere; an item without an id counts as an item of
    its own without a name (null); equal items are all named; repeated rows are searched each for itself; texts of any
    length are searched whole; columns of these four names are replaced, others pass through. The benchmark is read in
    passes of about ``pass_bytes``, each over all documents; a pass ends with a written table before the next part is
    fetched, so only one part is held at once.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = -(-total // pass_bytes) or 1
    df = docs.drop("n_words", "hits", "items", "contaminated")
    names = df.columns
    df = df.withColumns({"hits": F.expr("cast(array() as array<struct<start:int,end:int>>)"), "items": F.expr("cast(array() as array<string>)"), "n_words": F.lit(0).cast("long")})
    schema, place = df.schema, names.index(text)
    for k in range(passes):
        part = [(r["i"], r["t"]) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k).collect()]
        df = df.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(part), window, place), schema)
        if k < passes - 1:
            df = table(df, "searched")
    return df.withColumn("contaminated", F.size("hits") > 0)


def _scan(part, window: int, place: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        search = WuManber(part.value, window)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            hits, named, counts = [], [], []
            for words_of, old, had in zip(batch.column(place), batch.column("hits"), batch.column("items"), strict=True):
                w = words(words_of.as_py())
                spans, items = [(x["start"], x["end"]) for x in old.as_py()], set(had.as_py())
                for start, end, item in search.search(w):
                    spans.append((start, end))
                    items.add(search.names[item])
                hits.append([{"start": a, "end": b} for a, b in merged(spans)])
                named.append(sorted(items, key=lambda x: (x is None, x or "")))
                counts.append(len(w))
            columns = [*batch.columns[:-3], pa.array(hits, span), pa.array(named, pa.list_(pa.string())), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run
