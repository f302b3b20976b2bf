"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text.

The distinct n-grams of chunks of half of the trusted documents meet in shards by hash, where they are counted: trigrams
with the bigrams that are their contexts, bigrams with the trigrams that continue them, and words after that. The model
is these counts, as sorted arrays by shard. Documents are scored in groups by sharded joins: the distinct n-grams of a
chunk are dealt by hash to the shards and joined with the counts there, and log probabilities are summed per document
from what the chunk gets back. A document is kept if its perplexity is at most the quantile of its language among the
other half of the trusted documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.blocks import by_span, chunks, data_of, pack, unpack
from folioscope.llm.shared import discard, small, table
from folioscope.llm.shingles import mixed, word_hashes

#: The quantile kept of a language, and its least number of trusted documents.
QUANTILE = 0.995
LEAST = 50
#: A text's mean is drawn to the trusted mean as by so many words, so that a few odd words do not condemn a short text.
PRIOR = 20
BROADCAST_ROWS = 100_000
#: N-grams of the model, bytes of trained text and bytes of scored text that meet in a shard, at most about.
SHARD_ROWS = 500_000
TRAINED_BYTES = 2_000_000
SHARD_BYTES = 4_000_000
#: Groups that documents are scored in, one after the other; fewer where a group would have less text than GROUP_BYTES.
GROUPS = 8
GROUP_BYTES = 8_000_000
#: Parts of the shards that are counted, and joined with a group, one after the other: only one part's n-grams are on disk.
TRAIN_PARTS = 4
PARTS = 2
#: Text in a chunk, in bytes: a task holds its words and n-grams at once.
CHUNK_BYTES = 2_000_000
_START = np.uint64(0x5851F42D4C957F2D)
#: A trigram's hash begins with these bits of its context's, so that both are in one shard; no more bits choose a shard.
_BITS = 20
_HIGH = np.uint64((2**_BITS - 1) << (64 - _BITS))


def _hashes(sizes: list[int], packed: bytes) -> tuple[np.ndarray, ...]:
    """Words of each text of a chunk; for each word of all texts: whether it is the first of its text, and hashes of
    (u v w), (u v), (v w), v and w, with start marks before the first of a text."""
    w, n = word_hashes(data_of(sizes, packed), sizes)
    first = np.zeros(len(w), bool)
    first[(np.cumsum(n) - n)[n > 0]] = True
    v = _before(w, first, _START)
    vw = _pair(v, w)
    uv = _before(vw, first, _NOTHING)
    return n, first, (uv & _HIGH) | (mixed(_pair(uv, w), 3) & ~_HIGH), uv, vw, v, w


def _before(values: np.ndarray, first: np.ndarray, mark) -> np.ndarray:
    """For each word what the word before it has; ``mark`` for the first of a text."""
    out = np.roll(values, 1)
    out[first] = mark
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(0x9E3779B97F4A7C15) + b, 2)


#: The context of a first word.
_NOTHING = _pair(np.array([_START]), np.array([_START]))[0]


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where each different value of a sorted array begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))


def _distinct(values: np.ndarray) -> np.ndarray:
    ordered = np.sort(values)  # much faster than numpy.unique, which hashes
    return ordered[_starts(ordered)]


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=-1) if len(starts) else values[..., :0]


def _gathered(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their columns of ``counts``."""
    order = np.argsort(keys)
    starts = _starts(keys[order])
    return keys[order][starts], _sums(counts[:, order], starts)


def _below(contexts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each context: 0, the sum of ``counts``, and how many of them are 1, 2, and more."""
    return _gathered(contexts, np.stack([np.zeros_like(counts), counts, counts == 1, counts == 2, counts > 2]).astype(np.int64))


def _own(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return keys, np.concatenate([counts[None], np.zeros((4, len(counts)), np.int64)])


def _merged(*tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return _gathered(np.concatenate([k for k, _ in tables]), np.concatenate([c for _, c in tables], axis=1))


def _deltas(ordered: np.ndarray) -> bytes:
    return pack(np.diff(ordered, prepend=np.uint64(0)), 8)


def _keys(packed: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(packed, n, 8), dtype=np.uint64)


def _packed(counts: np.ndarray) -> bytes:
    """Counts in as many bytes as the largest takes, which the first byte says."""
    width = max(1, -(-int(counts.max(initial=0)).bit_length() // 8))
    return bytes([width]) + pack(counts.ravel(), width)


def _counts(packed: bytes, n: int) -> np.ndarray:
    return unpack(packed[1:], 5 * n, packed[0]).astype(np.int64).reshape(5, n)


def _histogram(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3, 4, at least 1; their sum."""
    return [*(int((counts == k).sum()) for k in (1, 2, 3, 4)), int((counts > 0).sum()), int(counts.sum())]


_MODEL = "shard long, n long, keys binary, counts binary"


def _slices(keys: np.ndarray, counts: np.ndarray, spans: int) -> Iterator[tuple]:
    for k, a, b in by_span(keys, 64, spans):
        yield k, b - a, _deltas(keys[a:b]), _packed(counts[:, a:b])


@dataclass
class KneserNey:
    """Tables (shard, n, keys, counts): n sorted n-grams and for each 5 counts: its own (of a trigram its occurrences, of
    a shorter one the different words before it), the sum of the own counts of the n-grams that it is the context of,
    and how many of those are 1, 2, and more. ``spans``: bits of the shard; ``discounts`` by length, trigrams first;
    ``whole``: the sum of the words' own counts."""

    tables: list[DataFrame]
    spans: int
    rows: int
    discounts: list[tuple[float, float, float]]
    whole: int
    floor: float


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3), strict=True))


def _seen(dealt: DataFrame, spans: int, part: int, parts: int) -> DataFrame:
    """(shard, kind, n, a, b, c) of each chunk, for shards that leave ``part`` modulo ``parts``: its trigrams by context,
    with that context and their count (kind 0); its trigrams by last two words (1); its bigrams with their words (2)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(kind: int, keys: np.ndarray, *more: tuple[np.ndarray, int]) -> Iterator[tuple]:
            for k, x, y in by_span(keys, 64, spans):
                packed = [pack(values[x:y], width) for values, width in more]
                yield k, kind, y - x, _deltas(keys[x:y]), packed[0], packed[-1]

        def ordered(of: np.ndarray, by: np.ndarray) -> np.ndarray:
            """The places whose ``by`` is in a shard of this part, in the order of ``of``."""
            mine = np.flatnonzero((by >> np.uint64(64 - spans)) % np.uint64(parts) == part)
            return mine[np.argsort(of[mine])]

        for batch in batches:
            for sizes, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, _, uvw, uv, vw, v, w = _hashes(sizes, packed.as_py())
                order = ordered(uvw, uvw)
                starts = _starts(uvw[order])
                at, count = order[starts], np.diff(starts, append=len(order))
                out = [*rows(0, uvw[at], (uv[at] & ~_HIGH, 6), (count, 4))]
                order = ordered(uvw, vw)
                of = order[_starts(uvw[order])]
                of = of[np.argsort(vw[of])]
                ends = vw[of]
                two = _starts(ends)
                out += [*rows(1, ends, (uvw[of], 8)), *rows(2, ends[two], (v[of[two]], 8), (w[of[two]], 8))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, [pa.int64()] * 3 + [pa.binary()] * 3, strict=True)], ["shard", "kind", "n", "a", "b", "c"])

    return dealt.select("sizes", "texts").mapInArrow(run, "shard long, kind long, n long, a binary, b binary, c binary")


def _counted(seen: DataFrame, spans: int, word_spans: int) -> DataFrame:
    """The model's rows of trigrams and bigrams, and by ranges of words (``words``) what a shard adds to theirs."""

    def run(pdf):
        import pandas as pd

        def column(kind: int, name: str, width: int) -> np.ndarray:
            of = pdf[pdf["kind"] == kind]
            read = _keys if name == "a" else lambda x, n: unpack(x, n, width)
            return np.concatenate([np.empty(0, np.uint64), *(read(x, n) for x, n in zip(of[name], of["n"], strict=True))])

        uvw, count = column(0, "a", 8), column(0, "c", 4).astype(np.int64)
        uv = (uvw & _HIGH) | column(0, "b", 6)
        order = np.argsort(uvw)
        starts = _starts(uvw[order])
        three, context, count = uvw[order][starts], uv[order][starts], _sums(count[order], starts)
        trigram, end = column(1, "b", 8), column(1, "a", 8)
        order = np.argsort(trigram)
        end = np.sort(end[order][_starts(trigram[order])])
        starts = _starts(end)
        two, before = end[starts], np.diff(starts, append=len(end))
        bigram = column(2, "a", 8)
        order = np.argsort(bigram)
        first = order[_starts(bigram[order])]
        v, w = column(2, "b", 8)[first], column(2, "c", 8)[first]
        keys, counts = _merged(_own(three, count), _own(two, before), _below(context, count))
        words, added = _merged(_own(w, np.ones(len(w), np.int64)), _below(v, before))
        stats = _histogram(count) + _histogram(before)
        out = [(int(pdf["shard"].iloc[0]), len(keys), _deltas(keys), _packed(counts), False, stats)]
        out += [(*x, True, [0] * 12) for x in _slices(words, added, word_spans)]
        return pd.DataFrame(out, columns=["shard", "n", "keys", "counts", "words", "stats"])

    return seen.groupBy("shard").applyInPandas(run, f"{_MODEL}, words boolean, stats array<long>")


def _of_words(rows: DataFrame, spans: int) -> DataFrame:
    """The model's rows of words, from what the shards add to them."""

    def run(pdf):
        import pandas as pd

        words, counts = _merged(*((_keys(x, n), _counts(c, n)) for x, c, n in zip(pdf["keys"], pdf["counts"], pdf["n"], strict=True)))
        out = [(*x, [0] * 6) for x in _slices(words, counts, spans)]
        out[0] = (*out[0][:4], _histogram(counts[0]))
        return pd.DataFrame(out, columns=["shard", "n", "keys", "counts", "stats"])

    return rows.groupBy("shard").applyInPandas(run, f"{_MODEL}, stats array<long>")


def _total(rows: DataFrame, length: int) -> list[int]:
    return [x or 0 for x in rows.agg(*(F.sum(F.col("stats")[i]) for i in range(length))).first()]


def _bits(size: int) -> int:
    return min(max(1, int(size).bit_length()), _BITS)


def train(texts: DataFrame, text: str = "text") -> KneserNey:
    """Fit on all texts given: the model has a few numbers for each n-gram, in written tables."""
    dealt = table(chunks(texts.select(F.lit(0).alias("id"), F.col(text).alias("text")), "id", "text", CHUNK_BYTES), "trained")
    size = dealt.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda n, x: n + x))).first()[0] or 0
    spans = _bits(size // TRAINED_BYTES)
    parts = TRAIN_PARTS if size > GROUP_BYTES else 1
    tables, added, stats = [], [], np.zeros(12, np.int64)
    for part in range(parts):
        both = table(_counted(_seen(dealt, spans, part, parts), spans, max(1, spans - 4)), "counts")
        tables.append(table(both.where("not words").drop("words", "stats"), "model"))
        added.append(table(both.where("words").drop("words", "stats"), "added"))
        stats += _total(both, 12)
        discard(both)
    discard(dealt)
    words = table(_of_words(reduce(DataFrame.unionByName, added), spans), "words")
    discard(*added)
    *ones, n, whole = _total(words, 6)
    discounts = [_discounts(*stats[:4].tolist()), _discounts(*stats[6:10].tolist()), _discounts(*ones)]
    n1, n2 = ones[:2]
    off = discounts[2][0] * n1 + discounts[2][1] * n2 + discounts[2][2] * (n - n1 - n2) if n else 1.0
    tables.append(words)
    return KneserNey(tables, spans, int(stats[4] + stats[10]) + n, discounts, max(whole, 1), off / max(whole, 1) / (n + 1))


def _asked(dealt: DataFrame, spans: int, part: int, parts: int) -> DataFrame:
    """(shard, chunk, n, grams): each chunk's distinct n-grams, sorted, by range of hash; shards that leave ``part`` modulo ``parts``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for chunk, sizes, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                _, _, uvw, _, vw, _, w = _hashes(sizes, packed.as_py())
                h = np.concatenate([uvw, vw, w, [_NOTHING, _START]])  # the contexts are among these
                value = _distinct(h[(h >> np.uint64(64 - spans)) % np.uint64(parts) == part])
                slices = by_span(value, 64, spans)
                columns = [
                    pa.array([k for k, _, _ in slices], pa.int64()),
                    pa.array([chunk] * len(slices), pa.int64()),
                    pa.array([b - a for _, a, b in slices], pa.int64()),
                    pa.array([_deltas(value[a:b]) for _, a, b in slices], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "chunk", "n", "grams"])

    return dealt.select("chunk", "sizes", "texts").mapInArrow(run, "shard long, chunk long, n long, grams binary")


def _answered(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(shard, chunk, n, places, counts): of the n-grams that the model has, the place in the chunk's shard and the counts."""

    def run(chunks, rows):
        import pandas as pd

        out = []
        if len(chunks) and len(rows):
            k = np.concatenate([_keys(x, n) for x, n in zip(rows["keys"], rows["n"], strict=True)])
            order = np.argsort(k)
            k, counts = k[order], np.concatenate([_counts(x, n) for x, n in zip(rows["counts"], rows["n"], strict=True)], axis=1)[:, order]
            for shard, chunk, n, packed in zip(chunks["shard"], chunks["chunk"], chunks["n"], chunks["grams"], strict=True):
                grams = _keys(packed, n)
                to = np.minimum(np.searchsorted(k, grams), len(k) - 1)
                at = np.flatnonzero(k[to] == grams)
                if len(at):
                    out.append((shard, chunk, len(at), pack(np.diff(at, prepend=0), 4), _packed(counts[:, to[at]])))
        return pd.DataFrame(out, columns=["shard", "chunk", "n", "places", "counts"])

    return asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(run, "shard long, chunk long, n long, places binary, counts binary")


def _finer(known: DataFrame, spans: int) -> DataFrame:
    """The model's rows cut into more shards."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for n, keys, counts in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                rows = list(_slices(_keys(keys, n), _counts(counts, n), spans))
                types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types, strict=True)], batch.schema.names)

    return known.mapInArrow(run, _MODEL)


def _log_p(first: np.ndarray, place: np.ndarray, counts: np.ndarray, model: tuple) -> np.ndarray:
    """The natural log probability of each word. ``place``: of trigrams, of bigrams, of words, of the context of a first
    word and of the mark before it, the column of ``counts``."""
    discounts, whole, floor = model
    uvw, vw, w = place[:-2].reshape(3, -1)
    p = np.maximum(counts[0, w] - _off(counts[0, w], discounts[2]), 0) / whole + floor
    for gram, context, d in ((vw, _before(w, first, place[-1]), discounts[1]), (uvw, _before(vw, first, place[-2]), discounts[0])):
        own, total = counts[0, gram], counts[1, context]
        # not a dot product, for which numpy starts threads
        weight = np.where(total > 0, (d[0] * counts[2] + d[1] * counts[3] + d[2] * counts[4])[context], 1) / np.maximum(total, 1)
        p = np.maximum(own - _off(own, d), 0) / np.maximum(total, 1) + weight * p
    return np.log(p)


def _off(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def score(docs: DataFrame, model: KneserNey, text: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``docs`` (without ``text``) with n_words and log_p, the sum of the natural log probabilities of its words.

    Documents are dealt by a hash of their columns into groups, and read once for each. A shard holds about ``shard_rows``
    n-grams of the model at most.
    """
    others = [c for c in docs.columns if c != text]
    whole = docs.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))).alias("id"), F.col(text).alias("text"))
    kind = whole.schema["id"].dataType.simpleString()
    size = whole.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = min(GROUPS, 1 + size // GROUP_BYTES)
    parts = PARTS if groups > 1 else 1
    spans = max(model.spans, _bits(size // groups // SHARD_BYTES), _bits(model.rows // shard_rows))
    known = reduce(DataFrame.unionByName, [t.select("shard", "n", "keys", "counts") for t in model.tables])
    if spans > model.spans:
        known = _finer(known, spans)
    numbers = model.discounts, model.whole, model.floor

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for ids, sizes, packed, answers in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                n, first, uvw, _, vw, _, w = _hashes(sizes, packed.as_py())
                h = np.concatenate([uvw, vw, w, [_NOTHING, _START]])
                order = np.argsort(h)
                starts = _starts(h[order])
                grams, place = h[order][starts], np.empty(len(h), np.int64)
                place[order] = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(h)))
                begin = {k: a for k, a, _ in by_span(grams, 64, spans)}
                counts = np.zeros((5, len(grams)), np.int64)
                for p in answers.as_py() or ():
                    at = begin[p["shard"]] + np.cumsum(unpack(p["places"], p["n"], 4)).astype(np.int64)
                    counts[:, at] = _counts(p["counts"], p["n"])
                sums = np.bincount(np.repeat(np.arange(len(n)), n), _log_p(first, place, counts, numbers), len(n)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(n), pa.array(sums)], ["id", "n_words", "log_p"])

    done = []
    for group in range(groups):
        dealt = table(chunks(whole.where(F.pmod(F.xxhash64("id", "text"), F.lit(groups)) == group), "id", "text", CHUNK_BYTES), "chunks")
        said = [table(_answered(_asked(dealt, spans, i, parts), known.where(F.pmod("shard", F.lit(parts)) == i)), "answers") for i in range(parts)]
        back = reduce(DataFrame.unionByName, said).groupBy("chunk").agg(F.collect_list(F.struct("shard", "n", "places", "counts")).alias("answers"))
        rows = dealt.join(back, "chunk", "left").select("ids", "sizes", "texts", "answers")
        done.append(table(rows.mapInArrow(run, f"id {kind}, n_words long, log_p double"), "scored"))
        discard(dealt, *said)
    return reduce(DataFrame.unionByName, done).select(*(F.col(f"id.c{i}").alias(c) for i, c in enumerate(others)), "n_words", "log_p")


def classify(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    trained: int | None = None,
    quantile: float = QUANTILE,
) -> DataFrame:
    """One row per document: doc_id, lang, n_words, perplexity, limit and kept.

    Trusted are the ids that ``labels`` gives quality 1 (repeated labels count once). Half of them are trained on, or
    about ``trained`` if that is given and less; all others set the limits. Perplexity is null without words;
    a null or empty text is not kept, nor is any text above its language's limit. A null language is one of its own;
    a language of fewer than LEAST trusted documents takes the limit of all. Without trusted documents the limit is
    null and every document with words is kept. Repeated rows give a row each; texts of any length are read whole; other
    columns, whatever their names, are not read; an empty table gives no rows.
    """
    trusted = table(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("trusted")).distinct(), "trusted")
    # at least half set the limits, at every size
    share = 0.5 if trained is None else min(0.5, trained / max(trusted.count(), 1))
    chance = F.pmod(F.xxhash64("trusted", F.lit("train")), F.lit(1 << 30)) / float(1 << 30)
    sample = trusted.where(chance < share)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    model = train(base.join(small(sample, sample.count(), BROADCAST_ROWS), F.col("doc_id") == F.col("trusted"), "left_semi"))
    scored = score(base, model)
    discard(*model.tables)
    unseen = trusted.where(chance >= share)
    held = scored.where("n_words > 0").join(unseen, F.col("doc_id") == F.col("trusted"), "left_semi")
    mean = held.agg((F.sum("log_p") / F.sum("n_words")).alias("m")).first()["m"] or 0.0
    smooth = -(F.col("log_p") + PRIOR * mean) / (F.col("n_words") + PRIOR)
    cut = F.percentile_approx(smooth, F.lit(quantile), F.lit(10_000))
    limits = held.groupBy("lang").agg(cut.alias("cut"), F.count("*").alias("n")).where(F.col("n") >= LEAST).select(F.col("lang").alias("of"), "cut")
    limits = table(limits, "limits")
    pooled = held.agg(cut.alias("cut")).first()["cut"]
    out = scored.join(small(limits, limits.count(), BROADCAST_ROWS), F.col("lang").eqNullSafe(F.col("of")), "left")
    limit = F.coalesce(F.col("cut"), F.lit(pooled).cast("double"))
    return out.select(
        "doc_id",
        "lang",
        "n_words",
        F.when(F.col("n_words") > 0, F.exp(-F.col("log_p") / F.col("n_words"))).alias("perplexity"),
        F.exp(limit).alias("limit"),
        ((F.col("n_words") > 0) & F.coalesce(smooth <= limit, F.lit(True))).alias("kept"),
    )
