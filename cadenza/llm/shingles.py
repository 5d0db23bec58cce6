"""Word shingles of Arrow text batches as 64-bit hashes, vectorised over the bytes of a whole batch.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. A text with ``k`` words or more has the
hashes of its ``k``-word windows; one with fewer has a single hash of the whole word sequence; one without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20260101).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE = _BYTE[_LOWER]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty texts."""
    col = col.fill_null("") if col.null_count else col
    col = col.cast(pa.large_string())
    _, offsets, data = col.buffers()
    ends = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``most`` bytes, a longer row alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of the first word of each row and the end)."""
    n = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    solid = ~_SEP[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1]] = True
    opens = solid.copy()
    opens[1:] &= ~solid[:-1] | first[1:-1]
    at = np.flatnonzero(solid)
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    within = np.searchsorted(at, starts)  # place of each word's first byte among the solid bytes
    sizes = np.diff(np.append(within, len(at)))
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(sizes.max()), _BASE)]), dtype=np.uint64)
    place = np.arange(len(at)) - np.repeat(within, sizes)
    words = np.add.reduceat(_BYTE[raw[at]] * powers[place], within)
    words = mix(words ^ (sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return words, np.searchsorted(starts, offsets)


def shingle_sets(col: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row of a batch."""
    raw, offsets = text_buffers(col)
    weights = [mix(np.uint64([i * 2 + 1]))[0] | np.uint64(1) for i in range(k)]
    for a, b in slices(offsets):
        words, bounds = word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        full = max(0, len(words) - k + 1)
        grams = np.zeros(full, np.uint64)
        for i, w in enumerate(weights):
            grams += words[i : i + full] * w
        grams = mix(grams)
        for row in range(a, b):
            s, e = bounds[row - a], bounds[row - a + 1]
            if e - s >= k:
                yield row, np.unique(grams[s : e - k + 1])
            elif e > s:
                place = np.arange(e - s, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(3 * k)
                yield row, mix((words[s:e] * (mix(place)[:, 0] | np.uint64(1))).sum(keepdims=True) + np.uint64(e - s))
            else:
                yield row, np.zeros(0, np.uint64)
