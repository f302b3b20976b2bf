"""Texts in chunks, and sorted integers in compressed blocks: how statistics of a whole corpus travel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a chunk (a longer document is a chunk of its own) and most documents in it.
CHUNK_BYTES = 6_000_000
CHUNK_ROWS = 100_000
#: Row numbers leave so many bits for the place in a chunk, chunk numbers so many for the chunk in its task.
PLACE_BITS, CHUNK_BITS = 17, 20


def pack(values: np.ndarray, width: int) -> bytes:
    """Integers of ``width`` bytes as byte planes, which compress well where high bytes are mostly zero."""
    import pyarrow as pa

    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(values) else b""


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    import pyarrow as pa

    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(data, n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def chunks(docs: DataFrame, doc_id: str, text: str, size: int | None = None) -> DataFrame:
    """(chunk, ids, sizes, texts): consecutive documents of a task, about ``size`` bytes, their UTF-8 texts compressed."""
    size = size or CHUNK_BYTES
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        no, total, ids, sizes, parts = TaskContext.get().partitionId() << CHUNK_BITS, 0, [], [], []

        def whole() -> pa.RecordBatch:
            packed = pa.compress(b"".join(parts), "zstd", asbytes=True) if total else b""
            columns = [pa.array([no], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([sizes], pa.list_(pa.int64())), pa.array([packed], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "sizes", "texts"])

        for batch in batches:
            id_type = batch.schema.types[0]
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (x.as_py() or "").encode()
                if ids and (total + len(data) > size or len(ids) == CHUNK_ROWS):
                    yield whole()
                    no, total, ids, sizes, parts = no + 1, 0, [], [], []
                total += len(data)
                ids.append(key)
                sizes.append(len(data))
                parts.append(data)
        if ids:
            yield whole()

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"chunk long, ids array<{kind}>, sizes array<long>, texts binary")


def data_of(sizes: list[int], packed: bytes) -> bytes:
    """The UTF-8 bytes of a chunk's texts, one after the other."""
    import pyarrow as pa

    return pa.decompress(packed, sum(sizes), "zstd", asbytes=True) if sum(sizes) else b""


def texts_of(sizes: list[int], packed: bytes) -> Iterator[str]:
    """The texts of a chunk, in order (empty for null ones)."""
    data, at = data_of(sizes, packed), 0
    for n in sizes:
        yield data[at : at + n].decode()
        at += n


def by_span(sorted_keys: np.ndarray, bits: int, spans: int) -> list[tuple[int, int, int]]:
    """(span, first, end): the slices of ``sorted_keys`` (of ``bits`` bits) in each of 2**spans equal ranges."""
    low = np.arange(1, 1 << spans, dtype=np.uint64) << np.uint64(bits - spans)
    edges = np.concatenate([[0], np.searchsorted(sorted_keys, low), [len(sorted_keys)]])
    return [(int(k), int(edges[k]), int(edges[k + 1])) for k in np.flatnonzero(np.diff(edges))]
