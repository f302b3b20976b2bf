"""LM scoring by stupid backoff over the n-gram counts of the whole corpus.

Documents are dealt into chunks. Each chunk's distinct n-grams are dealt by hash to the partitions of the count tables,
as sorted arrays. There the n-grams of a range are counted over all chunks in one sorted table (gram, total), with which
each chunk's n-grams are joined; n-grams that no other chunk has need no row back. The scores of each document's tokens
are summed from the counts of its chunk. A document's own occurrences are taken off the counts, so that it is scored by
the rest of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.blocks import by_span, chunks, pack, texts_of, unpack
from folioscope.llm.shared import table
from folioscope.llm.shingles import runs_of_many, words_of

ORDER = 3
DISCOUNT = 0.4
#: Text in a chunk, in bytes: a task holds its words and n-grams at once.
CHUNK_BYTES = 2_000_000
#: Text whose n-grams make up one bucket of the count tables, in bytes.
BUCKET_BYTES = 4_000_000
#: Parts of the count tables that are made one after the other, so that only one part's rows are on disk at a time.
PARTS = 2


def _ngrams(texts: Iterator[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and the n-grams of each order with the word they start at."""
    words = [words_of(t) for t in texts]
    return np.fromiter(map(len, words), np.int64, len(words)), runs_of_many(words, tuple(range(1, ORDER + 1)))


def exploded(dealt: DataFrame, spans: int, part: int = 0, parts: int = 1) -> DataFrame:
    """(bucket, chunk, n, grams, own): each chunk's distinct n-grams, sorted, and their counts in it, by range of hash, as blocks.

    Only the buckets that leave ``part`` modulo ``parts``.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for chunk, sizes, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                grams = [h[(h >> np.uint64(64 - spans)) % np.uint64(parts) == part] for h, _ in _ngrams(texts_of(sizes, packed.as_py()))[1]]
                value, count = np.unique(np.concatenate(grams), return_counts=True)
                slices = by_span(value, 64, spans)
                columns = [
                    pa.array([k for k, _, _ in slices], pa.int64()),
                    pa.array([chunk] * len(slices), pa.int64()),
                    pa.array([b - a for _, a, b in slices], pa.int64()),
                    pa.array([pack(np.diff(value[a:b], prepend=np.uint64(0)), 8) for _, a, b in slices], pa.binary()),
                    pa.array([pack(count[a:b], 4) for _, a, b in slices], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "n", "grams", "own"])

    return dealt.select("chunk", "sizes", "texts").mapInArrow(run, "bucket long, chunk long, n long, grams binary, own binary")


def shared_counts(rows: DataFrame) -> DataFrame:
    """(bucket, chunk, n, places, totals): of n-grams that several chunks have, their place in the chunk's bucket and
    their count, as blocks; n of them.

    ``rows`` as of ``exploded``. Every chunk has an n-gram once at most, so no n-gram weighs more than there are chunks.
    """

    def run(pdf):
        import pandas as pd

        grams = [np.cumsum(unpack(g, n, 8), dtype=np.uint64) for g, n in zip(pdf["grams"], pdf["n"], strict=True)]
        own = [unpack(c, n, 4).astype(np.int64) for c, n in zip(pdf["own"], pdf["n"], strict=True)]
        # the count table of the bucket: each n-gram with its total, where several chunks have it
        every = np.concatenate(grams)
        order = np.argsort(every)
        every = every[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        total = np.add.reduceat(np.concatenate(own)[order], first)
        several = np.diff(first, append=len(every)) > 1
        table, total = every[first][several], total[several]
        n, places, totals = [], [], []
        for g in grams:
            to = np.minimum(np.searchsorted(table, g), max(len(table) - 1, 0))
            at = np.flatnonzero(table[to] == g) if len(table) else np.empty(0, np.int64)
            n.append(len(at))
            places.append(pack(np.diff(at, prepend=0), 4))
            totals.append(pack(total[to[at]], 8))
        out = pd.DataFrame({"bucket": pdf["bucket"], "chunk": pdf["chunk"], "n": n, "places": places, "totals": totals})
        return out[out["n"] > 0]

    return rows.groupBy("bucket").applyInPandas(run, "bucket long, chunk long, n long, places binary, totals binary")


def backoff_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, log_score (sum of natural logs), mean_log_score (null without tokens).

    A token's score is the count of its longest n-gram that the other documents have (ORDER words at most) over that of
    its history, times DISCOUNT for each shorter step; a word they lack counts as half an occurrence. N-grams are
    compared by 64-bit hashes. Null and empty texts have no tokens and score 0; texts of any length are read whole (a
    text longer than a chunk is a chunk of its own); repeated rows are documents of their own; an empty table gives no
    rows; other columns, whatever their names, are not read.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    spans = max(1, size // BUCKET_BYTES).bit_length()
    dealt = table(chunks(docs, doc_id, text, CHUNK_BYTES), "chunks")
    kind = docs.schema[doc_id].dataType.simpleString()
    parts = [table(shared_counts(exploded(dealt, spans, i, PARTS)), "counts") for i in range(PARTS)]
    counted = reduce(DataFrame.unionByName, parts)
    tokens = counted_tokens(dealt)
    back = counted.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "places", "totals")).alias("parts"))

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for ids, sizes, packed, parts in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                n, grams = _ngrams(texts_of(sizes, packed.as_py()))
                known, place, corpus = np.unique(np.concatenate([h for h, _ in grams]), return_inverse=True, return_counts=True)
                first = {k: a for k, a, _ in by_span(known, 64, spans)}
                for p in parts.as_py() or ():
                    at = first[p["bucket"]] + np.cumsum(unpack(p["places"], p["n"], 4)).astype(np.int64)
                    corpus[at] = unpack(p["totals"], p["n"], 8)
                said = _scores(n, [at for _, at in grams], place, corpus, tokens).tolist()
                n = n.tolist()
                mean = [s / k if k else None for s, k in zip(said, n, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(n, pa.int64()), pa.array(said, pa.float64()), pa.array(mean, pa.float64())], ["doc_id", "n_tokens", "log_score", "mean_log_score"])

    rows = dealt.join(back, "chunk", "left").select("ids", "sizes", "texts", "parts")
    return rows.mapInArrow(score, f"doc_id {kind}, n_tokens long, log_score double, mean_log_score double")


def counted_tokens(dealt: DataFrame) -> int:
    """Words of all texts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n = [sum(len(words_of(t)) for t in texts_of(s, p.as_py())) for s, p in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n"])

    return dealt.select("sizes", "texts").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def _scores(n: np.ndarray, starts: list[np.ndarray], place: np.ndarray, corpus: np.ndarray, tokens: int) -> np.ndarray:
    """Sums of the log scores of texts of ``n`` words.

    ``starts``: for each order the word that each run starts at; ``place``: of all runs, order by order, the n-gram;
    ``corpus``: the count of each n-gram in all texts.
    """
    text = np.repeat(np.arange(len(n)), n)
    value, history, done = np.empty(len(text)), np.zeros(len(text)), 0
    for k, start in enumerate(starts, 1):
        grams, of = place[done : done + len(start)], text[start]
        done += len(start)
        _, at, own = np.unique(of * len(corpus) + grams, return_inverse=True, return_counts=True)
        rest = corpus[grams] - own[at]
        if k == 1:
            value = np.where(rest > 0, rest, 0.5) / np.maximum(tokens - n[of], 1)
        else:
            # the run that starts at a word ends k - 1 words on; its history is the shorter run that starts there
            end = start + k - 1
            value[end] = np.where(rest > 0, rest / np.maximum(history[start], 1), value[end] * DISCOUNT)
        history = np.zeros(len(text))
        history[start] = rest
    return np.bincount(text, np.log(value), len(n)) if len(text) else np.zeros(len(n))
