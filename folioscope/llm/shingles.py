"""Sets of word shingles as 64-bit hashes, computed by array operations over a whole text."""

from __future__ import annotations

import numpy as np

WORDS = 5
_rng = np.random.Generator(np.random.PCG64(7))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to ``length`` of them."""
    while len(_powers[0]) < length:
        n = len(_powers[0])
        for i, base in enumerate((_BASE, _INVERSE)):
            _powers[i] = np.concatenate([_powers[i], _powers[i] * np.uint64(pow(base, n, 2**64))])
    return _powers[0], _powers[1]


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ np.uint64(seed)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def sequences(words: list[bytes], k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words in their order; of all words together if there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    joined = np.frombuffer(b" ".join(words), np.uint8)
    power, inverse = _grown(len(joined) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[joined] * power[: len(joined)], dtype=np.uint64)])
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = starts + lengths
    k = min(k, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def shingle_set(text: str | None, k: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(sequences(words_of(text), k))


def runs(words: list[bytes], orders: tuple[int, ...]) -> list[np.ndarray]:
    """For each order, the hashes of all runs of so many words; none for an order beyond the words."""
    return [h for h, _ in runs_of_many([words], orders)]


def runs_of_many(texts: list[list[bytes]], orders: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, the hashes of all runs of so many words of one text, and where they start among all words."""
    words = [w for text in texts for w in text]
    if not words:
        return [(np.empty(0, np.uint64), np.empty(0, np.int64)) for _ in orders]
    joined = np.frombuffer(b" ".join(words), np.uint8)
    power, inverse = _grown(len(joined) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[joined] * power[: len(joined)], dtype=np.uint64)])
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = starts + lengths
    text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    out = []
    for k in orders:
        count = max(0, len(words) - k + 1)
        at = np.flatnonzero(text[:count] == text[len(words) - count :])
        out.append((mixed((sums[ends[at + k - 1]] - sums[starts[at]]) * inverse[starts[at]]), at))
    return out


#: Bytes that part words.
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def word_hashes(data: bytes, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that ``runs_of_many`` gives the words of texts, for texts of so many bytes that follow each other in
    ``data``, and how many words each has; words end at ASCII white space and at a text's end."""
    raw, size = np.frombuffer(data, np.uint8), np.array(sizes, np.int64)
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(len(size), np.int64)
    ends = np.cumsum(size)
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = ends[ends < len(raw)]
    begins[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    # a word goes to the next byte that is white space or another text's
    lasts = inside.copy()
    lasts[:-1] &= ~inside[1:]
    lasts[edge[edge > 0] - 1] = inside[edge[edge > 0] - 1]
    stops = np.flatnonzero(lasts) + 1
    power, inverse = _grown(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * power[: len(raw)], dtype=np.uint64)])
    n = np.diff(np.searchsorted(starts, ends, "left"), prepend=0)
    return mixed((sums[stops] - sums[starts]) * inverse[starts]), n
