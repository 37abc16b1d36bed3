"""Word shingles of whole texts as 64-bit hashes, computed on the bytes of an Arrow batch."""

from __future__ import annotations

import numpy as np

from .common import SPACE_BYTES, fixed_words, mix64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_BYTE = fixed_words(11, 256)
_PLACE = fixed_words(12, 64) | np.uint64(1)

#: Bytes hashed at a time; only a longer word needs more.
BLOCK = 1 << 20


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words of each text."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets) - 1, np.int64)
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased.

    It adds up one scrambled number for each pair of a byte and its place in the word. Unlike in a
    polynomial modulo 2^64, no pattern of bytes makes the numbers of two words cancel.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        origin = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, origin + BLOCK, "right")))
        s, sizes = starts[i:j] - origin, ends[i:j] - starts[i:j]
        first = np.cumsum(sizes) - sizes
        place = np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)
        letter = _BYTE[_LOWER[data[origin : ends[j - 1]][np.repeat(s, sizes) + place]]]
        cells = mix64(letter ^ (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        out[i:j] = mix64(np.add.reduceat(cells, first) + sizes.astype(np.uint64))
        i = j
    return out


def text_shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes in order and their number per text.

    A text with fewer than ``size`` words has its whole sequence as its one shingle; one without
    words has none.
    """
    starts, ends, counts = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    length = np.minimum(counts, size)
    made = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    begins = np.concatenate([[0], np.cumsum(counts)])
    total = int(made.sum())
    out = np.zeros(total, np.uint64)
    row = np.repeat(np.arange(len(counts)), made)
    at = begins[row] + np.arange(total) - np.repeat(np.cumsum(made) - made, made)
    span = length[row]
    for k in range(size):
        live = span > k
        if live.all():
            out += words[at + k] * _PLACE[k]
        else:
            out[live] += words[at[live] + k] * _PLACE[k]
    return mix64(out + span.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), made
