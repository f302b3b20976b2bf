"""Language identification by a byte convolutional network.

Text is cut into windows of WINDOW bytes. Bytes are embedded, filters of several widths slide over them, each filter's
maximum over the window is kept, and a softmax layer turns the maxima into label probabilities. The network is trained
here, in numpy, on windows of a bounded sample of labelled documents, and applied to all windows of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 24
EMBEDDING = 8
#: Bounds of the training sample: documents of a label (about) and of all labels, windows of a document. All labels are
#: learned; with over ALL_DOCUMENTS / DOCUMENTS of them, fewer documents of each.
DOCUMENTS = 400
ALL_DOCUMENTS = 40_000
WINDOWS = 4
EPOCHS = 10
UNKNOWN = "und"
_WIDEST = max(WIDTHS)


def to_windows(text: str) -> np.ndarray:
    """All windows of a text, as rows of bytes; the last is padded with zeros. Each overlaps the next by a filter."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    step = WINDOW - _WIDEST + 1
    count = max(1, -(-(len(data) - _WIDEST + 1) // step))
    padded = np.zeros((count - 1) * step + WINDOW, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]


@dataclass
class ByteConvNet:
    labels: list[str]
    table: np.ndarray  # 256 x EMBEDDING
    filters: np.ndarray  # _WIDEST * EMBEDDING x filters; narrower filters end in zeros
    bias: np.ndarray
    head: np.ndarray  # filters x labels
    offset: np.ndarray

    def patches(self, windows: np.ndarray) -> np.ndarray:
        embedded = self.table[windows].reshape(len(windows), -1)
        view = np.lib.stride_tricks.sliding_window_view(embedded, _WIDEST * EMBEDDING, axis=1)[:, ::EMBEDDING]
        return np.ascontiguousarray(view)

    def log_probabilities(self, windows: np.ndarray, together: int = 16) -> np.ndarray:
        out = []
        for first in range(0, len(windows), together):
            x = self.patches(windows[first : first + together])
            y = x.reshape(-1, x.shape[2]) @ self.filters
            pooled = np.maximum(y.reshape(len(x), -1, y.shape[1]).max(axis=1) + self.bias, 0)
            out.append(pooled @ self.head + self.offset)
        z = np.concatenate(out)
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.labels or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        windows = to_windows(text)
        weight = (windows > 0x60).sum(axis=1) + 1e-3
        said = (self.log_probabilities(windows) * weight[:, None]).sum(axis=0) / weight.sum()
        p = np.exp(said - said.max())
        best = int(p.argmax())
        return self.labels[best], float(min(1.0, p[best] / p.sum()))


def fit(windows: np.ndarray, targets: np.ndarray, labels: list[str], epochs: int = EPOCHS, seed: int = 3) -> ByteConvNet:
    """Train by Adam on cross-entropy; the gradient of a maximum flows to the place that gave it."""
    rng = np.random.default_rng(seed)
    count = FILTERS * len(WIDTHS)
    mask = np.zeros((_WIDEST * EMBEDDING, count), np.float32)
    for i, width in enumerate(WIDTHS):
        mask[: width * EMBEDDING, i * FILTERS : (i + 1) * FILTERS] = 1
    net = ByteConvNet(
        labels,
        rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32),
        np.zeros(count, np.float32),
        rng.normal(0, 0.1, (count, len(labels))).astype(np.float32),
        np.zeros(len(labels), np.float32),
    )
    names = ("table", "filters", "bias", "head", "offset")
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    share = np.bincount(targets, minlength=len(labels)).astype(np.float32)
    weight = (len(targets) / (len(labels) * np.maximum(share, 1)))[targets]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for at in np.array_split(order, max(1, len(order) // 32)):
            w, y = windows[at], targets[at]
            x = net.patches(w)
            scores = (x.reshape(-1, x.shape[2]) @ net.filters).reshape(len(x), -1, count)
            place = scores.argmax(axis=1)
            raw = np.take_along_axis(scores, place[:, None], 1)[:, 0] + net.bias
            pooled = np.maximum(raw, 0)
            z = pooled @ net.head + net.offset
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= (weight[at] / len(y))[:, None]
            down = (p @ net.head.T) * (raw > 0)
            best = x[np.arange(len(x))[:, None], place]
            to_patch = down[:, :, None] * net.filters.T[None]
            table = np.zeros_like(net.table)
            for k in range(_WIDEST):
                byte = np.take_along_axis(w, place + k, 1)
                np.add.at(table, byte.ravel(), to_patch[:, :, k * EMBEDDING : (k + 1) * EMBEDDING].reshape(-1, EMBEDDING))
            slopes = {
                "table": table,
                "filters": np.einsum("bf,bfe->ef", down, best) * mask,
                "bias": down.sum(axis=0),
                "head": pooled.T @ p,
                "offset": p.sum(axis=0),
            }
            step += 1
            rate = 0.01 * (1 - epoch / epochs)
            for n, slope in slopes.items():
                first[n] = 0.9 * first[n] + 0.1 * slope
                second[n] = 0.999 * second[n] + 0.001 * slope * slope
                moved = first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                setattr(net, n, (getattr(net, n) - rate * moved).astype(np.float32))
    return net


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", documents: int = DOCUMENTS) -> ByteConvNet:
    """Fit on about ``documents`` documents of each label (ALL_DOCUMENTS in all at most), chosen by a hash of the id.

    Rows with a null label, null or empty text, or held out, are not used. Without any usable row the net has no
    labels and says UNKNOWN.
    """
    usable = docs.where(~held_out(doc_id) & F.col(lang).isNotNull() & (F.length(text) > 0))
    counts = usable.groupBy(F.col(lang).alias("lang")).count().collect()
    documents = max(1, min(documents, ALL_DOCUMENTS // max(1, len(counts))))
    labels = sorted(r["lang"] for r in counts)
    if not labels:
        return ByteConvNet([], np.empty(0), np.empty(0), np.empty(0), np.empty(0), np.empty(0))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, documents / r["count"]))])
    chance = F.pmod(F.xxhash64(F.col(doc_id), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    chosen = usable.where(chance < F.element_at(share, F.col(lang))).select(F.col(lang), F.col(text))

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            said, rows = [], []
            for label, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = to_windows(x.as_py())
                for i in np.unique(np.linspace(0, len(w) - 1, WINDOWS).astype(int)):
                    said.append(label)
                    rows.append(w[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(said, pa.string()), pa.array(rows, pa.binary())], ["label", "bytes"])

    rows = chosen.mapInArrow(cut, "label string, bytes binary").limit(4 * WINDOWS * documents * len(labels)).toPandas()
    rows = rows.sort_values(["label", "bytes"], ignore_index=True)
    windows = np.frombuffer(b"".join(rows["bytes"]), np.uint8).reshape(-1, WINDOW)
    return fit(windows, np.array([labels.index(x) for x in rows["label"]], np.int64), labels)


def identify(docs: DataFrame, net: ByteConvNet, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1); UNKNOWN and 0 for a text that is null or has no letter.

    Every window of a text counts, by its bytes of letters. Repeated rows are read each for itself; columns of the two
    names are replaced, others pass through; an empty table stays empty.
    """
    df = docs.drop("lang_pred", "score").withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)})
    place, schema = df.columns.index(text), df.schema
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            said = [shared.value.predict(x.as_py()) for x in batch.column(place)]
            columns = [*batch.columns[:-2], pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(run, schema)
