"""Vectorised word hashing: whole Arrow batches of texts to numpy arrays of word and shingle hashes."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240101))
_OF_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}

# Byte classes: True where a byte parts words.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each span: equal spans of 64-bit values have equal hashes wherever they lie."""
    up, down = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column without nulls, and the n + 1 offsets of its texts."""
    import pyarrow as pa

    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[places[0] : places[-1]], places - places[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the index of its first word (n + 1 numbers)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~parts[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    borders = offsets[1:-1]
    first[borders] = inside[borders]  # a word can't go on into the next text
    starts = np.flatnonzero(first[:-1])
    stop = np.zeros(len(data) + 1, bool)
    stop[1:] = inside[:-1] & (~inside[1:] | first[1:])
    ends = np.flatnonzero(stop)
    return starts, ends, np.searchsorted(starts, offsets)


def hashed_words(column, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, A-Z lower-cased, and each text's first word (n + 1 numbers)."""
    data, offsets = text_bytes(column)
    starts, ends, at = word_spans(data, offsets, parts)
    return span_hashes(_OF_BYTE[LOWER[data]], starts, ends), at


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of so many words."""
    starts = np.arange(max(0, len(words) - width + 1))
    return span_hashes(words, starts, starts + width)


def batches_of(batches, size: int = 2 << 20):
    """Arrow batches re-cut so that none holds much more than so many bytes of text, unless one text does."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column("text"))
        cuts, k = [0], 0
        while k < batch.num_rows:
            k = max(k + 1, int(np.searchsorted(offsets, offsets[k] + size, "right")) - 1)
            cuts.append(min(k, batch.num_rows))
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
