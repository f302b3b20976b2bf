"""Keywords as a table: any number of them, counted in one look at the pages.

Keywords that are all one whole word are joined with the pages' words. If there are phrases or punctuation among them, a
page is walked through word by word as long as a filter of bounded size knows what was said so far as a keyword's
beginning, and what it takes for a keyword is joined with the table. Parts of words are found by an automaton over all of
them at once, or, where they are too many for it, by the same walk character by character. Where only the sums over all
pages are asked for, a walk sums up before it hands on, so one look at the pages does. All count as ``functions.keywords``
does, keyword by keyword, without an expression for each, and no page is read once more because there are more keywords.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.keywords import WORD, strip

#: Keywords that are broadcast (to be joined, or as one automaton); more are shuffled.
BROADCAST_KEYWORDS = 200_000
#: Bits of the filter: 32 a keyword, within these bounds (32 MB at most); it is put together in slices.
FILTER_BITS, SLICE_BITS = (16, 28), 16
#: Characters that a walk takes at once; longer texts are cut into overlapping pieces.
STRETCH = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_WHOLE, _MORE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _folded(c: str) -> str:
    """The character that case-insensitive matching takes ``c`` for: upper and lower case by single characters."""
    upper = c.upper() if len(c.upper()) == 1 else c
    lower = upper.lower()
    return lower if len(lower) == 1 else {"İ": "i"}.get(upper, upper)


@cache
def _unusual() -> tuple[str, str]:
    """Characters for which the lower case of a string says something else than ``_folded``, and what that is."""
    apart = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if (c.lower() != c or c.upper() != c) and (_folded(c) != c.lower() or c in "Σσς")]
    return "".join(apart), "".join(map(_folded, apart))


def folded(text: Column | str) -> Column:
    """The text as case-insensitive matching sees it; as many characters as before."""
    column = F.col(text) if isinstance(text, str) else text
    plain = F.octet_length(column) == F.length(column)
    return F.when(plain, F.lower(column)).otherwise(F.lower(F.translate(column, *_unusual())))


class _Fold(dict):
    """A table for str.translate that learns characters as it meets them."""

    def __missing__(self, code: int) -> str:
        self[code] = _folded(chr(code))
        return self[code]


def distinct_keywords(keywords: DataFrame) -> DataFrame:
    """(ord, keyword): stripped, the empty and the null left out, the first of equal ones kept."""
    said = keywords.select("ord", strip(F.col("keyword")).alias("keyword")).where("keyword <> ''")
    return said.groupBy("keyword").agg(F.min("ord").alias("ord")).select("ord", "keyword")


def _by_words(pages: DataFrame, keywords: DataFrame, few: bool, case_sensitive: bool) -> DataFrame:
    same = (lambda c: F.col(c)) if case_sensitive else folded
    words = pages.select("doc_id", "page", F.explode(F.regexp_extract_all("text", F.lit(WORD + "+"), F.lit(0))).alias("word"))
    keys = keywords.select("ord", "keyword", same("keyword").alias("key"))
    if few:
        found = words.select("doc_id", "page", same("word").alias("key")).join(F.broadcast(keys), "key")
        return found.groupBy("doc_id", "page", "ord", "keyword").agg(F.count("*").alias("n"))
    # words are summed up by page before the shuffle, and no key of the join holds more rows than there are pages
    counted = words.select("doc_id", "page", same("word").alias("key")).groupBy("doc_id", "page", "key").agg(F.count("*").alias("n"))
    return counted.join(keys, "key").select("doc_id", "page", "ord", "keyword", "n")


def _by_automaton(pages: DataFrame, keywords: list[tuple[int, str]], case_sensitive: bool) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import ahocorasick
        import pyarrow as pa

        table = _Fold()
        fold = (lambda t: t) if case_sensitive else (lambda t: t.lower() if t.isascii() else t.translate(table))
        automaton, same = ahocorasick.Automaton(), {}
        for no, (_, k) in enumerate(keywords):
            same.setdefault(fold(k), []).append(no)
        for key, numbers in same.items():
            automaton.add_word(key, (len(key), numbers))
        automaton.make_automaton()
        ords, names = pa.array([o for o, _ in keywords], pa.int64()), pa.array([k for _, k in keywords], pa.string())

        for batch in batches:
            rows, found, counts = [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                if not text:
                    continue
                seen = fold(text)
                n, free = {}, {}
                for last, (size, numbers) in automaton.iter(seen):
                    start, mark = last - size + 1, numbers[0]
                    if start < free.get(mark, 0):
                        continue
                    free[mark] = last + 1
                    for no in numbers:
                        n[no] = n.get(no, 0) + 1
                rows += [row] * len(n)
                found += n.keys()
                counts += n.values()
            at, no = pa.array(rows, pa.int64()), pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), ords.take(no), names.take(no), pa.array(counts, pa.int64())], ["doc_id", "page", "ord", "keyword", "n"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("doc_id", "page", "text").mapInArrow(run, f"doc_id {kinds['doc_id']}, page {kinds['page']}, ord long, keyword string, n long")


@cache
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code: what case-insensitive matching takes a character for; whether it is a word's; whether it is taken for
    some that are a word's and for some that are not."""
    fold = np.fromiter((ord(_folded(c)) if c.lower() != c or c.upper() != c else ord(c) for c in map(chr, range(sys.maxunicode + 1))), np.uint32)
    word = np.fromiter((c.isalnum() or c == "_" for c in map(chr, range(sys.maxunicode + 1))), bool)
    mixed = np.zeros(len(fold), bool)
    mixed[fold[word != word[fold]]] = True
    return fold, word, mixed


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hashes' base, and of its inverse, modulo 2^64."""
    up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _places(hashes: np.ndarray, salt: np.uint64, bits: int) -> np.ndarray:
    return ((hashes ^ hashes >> np.uint64(32)) * salt >> np.uint64(64 - bits)).astype(np.int64)


class _Said:
    """Texts end to end, cut into units: runs of a kind if ``whole_words``, else characters."""

    def __init__(self, texts: list[str], case_sensitive: bool, whole_words: bool):
        fold, word, mixed = _characters()
        own = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        #: Each text's first place and the one after its last; no text is empty.
        self.upto = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        self.begins = np.r_[0, self.upto[:-1]]
        self.codes = codes = own if case_sensitive else fold[own]
        #: Whether a character is a word's: as it stands, and as it is matched.
        self.own, self.kind = word[own], word[codes]
        if whole_words:
            cut = np.r_[True, self.kind[1:] != self.kind[:-1]]
            cut[self.begins] = True
            if not case_sensitive and (alone := mixed[codes]).any():
                cut |= alone
                cut[1:] |= alone[:-1]
            self.starts = np.flatnonzero(cut)
        else:
            self.starts = np.arange(len(codes))
        self.ends = np.r_[self.starts[1:], len(codes)]
        #: The number of the first unit that is the next text's, and the text of each unit.
        self.over = np.searchsorted(self.starts, self.upto)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.over, prepend=0))
        up, self.down = _powers(1 << (len(codes) - 1).bit_length())
        self.sums = np.r_[np.uint64(0), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], dtype=np.uint64)]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def between(self, start: np.ndarray, end: np.ndarray):  # noqa: ANN201
        """What is said from start to end, as an Arrow array of UTF-32."""
        import pyarrow as pa

        upto = np.cumsum(end - start)
        codes = self.codes[np.arange(upto[-1] if len(upto) else 0) + np.repeat(end - upto, end - start)]
        return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.r_[0, 4 * upto].astype(np.int64)), pa.py_buffer(codes)])

    def bounded(self, at: np.ndarray, inside: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Whether what is said has a boundary: ``at`` is the place beyond it, ``inside`` the one within, ``edge`` says that
        the text has no more there."""
        return (self.own[np.where(edge, 0, at)] & ~edge) != self.kind[inside]


def _known(keywords: DataFrame, n: int, case_sensitive: bool, whole_words: bool) -> tuple[np.ndarray, int]:
    """A filter over ``n`` keywords and their beginnings, unit by unit, and the bits of a place in it."""
    bits = min(max((32 * n - 1).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])

    def places(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for pieces, _ in _stretches(batch.column(0).to_pylist(), None):
                said = _Said([text for *_, text in pieces], case_sensitive, whole_words)
                hashes = said.hashes(said.begins[said.text], said.ends)
                whole = said.ends == said.upto[said.text]
                at = np.unique(np.r_[_places(hashes[whole], _WHOLE, bits), _places(hashes[~whole], _MORE, bits)])
                yield pa.RecordBatch.from_arrays([pa.array(at >> SLICE_BITS), pa.array(at & (1 << SLICE_BITS) - 1)], ["slice", "at"])

    def slices(batches: Iterator) -> Iterator:
        import pyarrow as pa

        made: dict[int, np.ndarray] = {}
        for batch in batches:
            of, at = (c.to_numpy() for c in batch.columns)
            for no in np.unique(of).tolist():
                here = at[of == no]
                np.bitwise_or.at(made.setdefault(no, np.zeros(1 << SLICE_BITS - 3, np.uint8)), here >> 3, np.left_shift(1, here & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array([m.tobytes() for m in made.values()], pa.binary())], ["slice", "bits"])

    known = np.zeros(1 << bits - 3, np.uint8)
    for no, part in keywords.select("keyword").mapInArrow(places, "slice long, at long").repartition("slice").mapInArrow(slices, "slice long, bits binary").collect():
        known[no << SLICE_BITS - 3 : (no + 1) << SLICE_BITS - 3] = np.frombuffer(part, np.uint8)
    return known, bits


def _stretches(texts: list[str | None], longest: int | None) -> Iterator[tuple[list[tuple[int, int, int, str]], bool]]:
    """Pieces (row, place of its first character, place of the first that is its own, text), some STRETCH characters at
    once, and whether the last row is done with. A piece has STRETCH characters of its own and reaches ``longest`` and
    one beyond them; without ``longest`` texts are not cut."""
    pieces, size = [], 0
    for row, text in enumerate(texts):
        n = len(text or "")
        for at in range(0, n, STRETCH if longest is not None else n or 1):
            first = max(at - 1, 0)
            pieces.append((row, first, at, text if longest is None else text[first : at + STRETCH + longest + 1]))
            size += len(pieces[-1][-1])
            if size >= STRETCH:
                yield pieces, longest is None or at + STRETCH >= n
                pieces, size = [], 0
    if pieces:
        yield pieces, True


def _by_walk(pages: DataFrame, keywords: DataFrame, n: int, longest: int, case_sensitive: bool, whole_words: bool, summed: bool = False) -> DataFrame:
    """(doc_id, page, key, n): whatever the filter over ``keywords`` takes for one of them, folded, with its matches; if
    ``summed`` (key, pages, n): the pages of a batch that have it, and its matches there."""
    known, bits = _known(keywords, n, case_sensitive, whole_words)
    shared = pages.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def knows(hashes: np.ndarray, salt: np.uint64) -> np.ndarray:
            at = _places(hashes, salt, bits)
            return (shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

        def walk(pieces: list) -> tuple:
            """Row, start and end of what may be keywords, whether it is one unit only, and the text of each."""
            said = _Said([text for *_, text in pieces], case_sensitive, whole_words)
            row, first, own = (np.array([p[i] for p in pieces], np.int64) for i in range(3))
            shift = (first - said.begins)[said.text]
            place = said.starts + shift
            good = (place >= own[said.text]) & (place < own[said.text] + STRETCH)
            if whole_words:
                good &= said.bounded(said.starts - 1, said.starts, said.starts == said.begins[said.text])
            begun = last = np.flatnonzero(good)
            found = [(begun[:0], begun[:0])]
            while len(begun):
                start, end = said.starts[begun], said.ends[last]
                hashes, of = said.hashes(start, end), said.text[begun]
                there = np.flatnonzero(knows(hashes, _WHOLE))
                if whole_words:
                    there = there[said.bounded(end[there], end[there] - 1, end[there] == said.upto[of[there]])]
                found.append((begun[there], last[there]))
                on = (last + 1 < said.over[of]) & knows(hashes, _MORE)
                begun, last = begun[on], last[on] + 1
            begun, last = (np.concatenate(x) for x in zip(*found, strict=True))
            start, end, shift = said.starts[begun], said.ends[last], shift[begun]
            return row[said.text[begun]], start + shift, end + shift, begun == last, said.between(start, end)

        def counted(batch, found: list):  # noqa: ANN202
            row, start, end, alone = (np.concatenate([f[i] for f in found]) for i in range(4))
            keys = pa.concat_arrays([f[4] for f in found]).dictionary_encode()
            key, said = keys.indices.to_numpy().astype(np.int64), [k.decode("utf-32-le") for k in keys.dictionary.to_pylist()]
            at = row * max(len(said), 1) + key
            several = np.flatnonzero(~alone)
            several = several[np.lexsort((start[several], at[several]))]
            a, b, of = start[several], end[several], at[several]
            if ((of[1:] == of[:-1]) & (a[1:] < b[:-1])).any():  # matches of a keyword do not overlap: the first goes
                before, free, over = -1, 0, []
                for i, x, y, z in zip(several.tolist(), a.tolist(), b.tolist(), of.tolist(), strict=True):
                    if z != before or x >= free:
                        before, free = z, y
                    else:
                        over.append(i)
                at = np.delete(at, over)
            at, n = np.unique(at, return_counts=True)
            row, key = np.divmod(at, max(len(said), 1))
            said = pa.array(said, pa.string())
            if summed:
                sums = np.zeros(len(said), np.int64)
                np.add.at(sums, key, n)
                return pa.RecordBatch.from_arrays([said, pa.array(np.bincount(key, minlength=len(said)), pa.int64()), pa.array(sums)], ["key", "pages", "n"])
            row = pa.array(row)
            return pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), said.take(pa.array(key)), pa.array(n, pa.int64())], ["doc_id", "page", "key", "n"])

        for batch in batches:
            found = []
            for pieces, done in _stretches(batch.column(2).to_pylist(), longest):
                found.append(walk(pieces))
                if done:
                    yield counted(batch, found)
                    found = []

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("doc_id", "page", "text").mapInArrow(run, "key string, pages long, n long" if summed else f"doc_id {kinds['doc_id']}, page {kinds['page']}, key string, n long")


def _keyed(keywords: DataFrame, case_sensitive: bool) -> DataFrame:
    """(ord, keyword, key): each keyword and how a walk says it."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = _Fold()
        for batch in batches:
            key = [k if case_sensitive else k.translate(table) for k in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, pa.string())], ["ord", "keyword", "key"])

    return keywords.select(F.col("ord").cast("long").alias("ord"), "keyword").mapInArrow(run, "ord long, keyword string, key string")


def _sizes(wanted: DataFrame, whole_words: bool) -> tuple[list, int, int]:
    """The keywords' lengths with the number of those that are one word and of the others, and the sums of both."""
    is_word = F.col("keyword").rlike(f"^{WORD}+$") if whole_words else F.lit(False)
    sizes = wanted.groupBy(F.length("keyword").alias("size")).agg(F.count_if(is_word), F.count_if(~is_word)).orderBy("size").collect()
    return sizes, *(sum(r[i] for r in sizes) for i in (1, 2))


def hits(pages: DataFrame, keywords: DataFrame, case_sensitive: bool = False, whole_words: bool = True, at_once: int = BROADCAST_KEYWORDS) -> DataFrame:
    """(doc_id, page, ord, keyword, n): matches of each keyword of ``keywords`` (ord, keyword) on each page, where any.

    Keywords are stripped; null and empty ones count for nothing, of equal ones the first counts. A null text is empty.
    Of a table of more than ``at_once`` keywords, so many of the shortest, which are likely to match most, are broadcast and
    the others joined by a shuffle, each of the two in one look at the pages.
    """
    wanted = distinct_keywords(keywords)
    sizes, n_words, n_others = _sizes(wanted, whole_words)
    parts = []
    if n_words and not n_others:
        parts.append(_by_words(pages, wanted.withColumn("ord", F.col("ord").cast("long")), n_words <= at_once, case_sensitive))
    elif not whole_words and 0 < n_others <= at_once:
        parts.append(_by_automaton(pages, sorted((r["ord"], r["keyword"]) for r in wanted.collect()), case_sensitive))
    elif n_others:
        short = n_short = 0
        for size, *both in sizes:
            if n_short + sum(both) > at_once:
                break
            short, n_short = size, n_short + sum(both)
        length = F.length("keyword")
        for n, longest, which in ((n_short, short, length <= short), (n_words + n_others - n_short, sizes[-1][0], length > short)):
            if n:
                some = wanted.where(which)
                keys = _keyed(some, case_sensitive)
                found = _by_walk(pages, some, n, longest, case_sensitive, whole_words)
                parts.append(found.join(F.broadcast(keys) if n <= at_once else keys, "key").select("doc_id", "page", "ord", "keyword", "n"))
    if not parts:
        return pages.select("doc_id", "page", F.lit(0).cast("long").alias("ord"), F.lit("").alias("keyword"), F.lit(0).cast("long").alias("n")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def totals(found: DataFrame, keywords: DataFrame) -> DataFrame:
    """(ord, keyword, pages, total) of hits: each distinct keyword has a row, those without a match too."""
    summed = found.groupBy("keyword").agg(F.count("*").alias("pages"), F.sum("n").alias("total"))
    none = F.lit(0).cast("long")
    return distinct_keywords(keywords).join(summed, "keyword", "left").select("ord", "keyword", F.coalesce("pages", none).alias("pages"), F.coalesce("total", none).alias("total"))


def sums(pages: DataFrame, keywords: DataFrame, case_sensitive: bool = False, whole_words: bool = True, at_once: int = BROADCAST_KEYWORDS) -> DataFrame:
    """``totals`` of ``hits``. Where pages are walked through this is one walk, whatever the number of keywords, and what
    leaves it are a batch's sums by key."""
    wanted = distinct_keywords(keywords)
    sizes, n_words, n_others = _sizes(wanted, whole_words)
    if not n_others or not whole_words and n_others <= at_once:
        return totals(hits(pages, keywords, case_sensitive, whole_words, at_once), keywords)
    found = _by_walk(pages, wanted, n_words + n_others, sizes[-1][0], case_sensitive, whole_words, summed=True)
    summed = found.groupBy("key").agg(F.sum("pages").alias("pages"), F.sum("n").alias("total"))
    none = F.lit(0).cast("long")
    kept = _keyed(wanted, case_sensitive).join(summed, "key", "left")
    return kept.select(F.col("ord").cast(wanted.schema["ord"].dataType).alias("ord"), "keyword", F.coalesce("pages", none).alias("pages"), F.coalesce("total", none).alias("total"))


def pages_with_any(found: DataFrame) -> DataFrame:
    """(doc_id, page) of hits, each once."""
    return found.select("doc_id", "page").distinct()
